"""Personal data (operator 10): fixed patterns, and a linear-chain CRF over word-shape features.

The patterns give the base spans.  The CRF adds spans that no pattern has, such as phone numbers without a country
code, addresses with a spelled-out @, IPv6 and card numbers with other separators.  What it marks is added as it is,
if the value can be of that kind at all.  It is trained from the small labelled table below and decoded by Viterbi
over numpy batches.  Tokens far from any digit, @, ::, "dot" or bracketed "at" are outside by definition, so that only
short stretches around those are decoded."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits whose start fails, so the run's start is tried only, without backtracking.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part reaches back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind in the order of KINDS; code points, end exclusive."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", *s) for s in _ips(text)]
        spans += [("card", *s) for s in _cards(text)]
        if "+" in text:
            spans += [("phone", *s) for s in _phones(text)]
    return ordered(spans)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---------------------------------------------------------------- the CRF

#: Labelled examples: <kind>...</> marks a span.
LABELLED = """
call me at <phone>(652) 555-4544</> today
my number is <phone>652-555-4544</> , ask for Ann
tel. <phone>(212) 555-0199</> or write
Reach us : <phone>415 555 2671</> .
fax <phone>415.555.2671</>
office <phone>030 555 0147</> mornings
phone <phone>+49 (30) 555-01234</> ext
<phone>+1 (476) 555-6291</> is the line
the number <phone>800-555-0100</> is free
ring <phone>020 7946 0958</> after six
<phone>020 7946 0011</> or <phone>0161 496 0123</> in the north
mobile <phone>07700 900123</> , home <phone>01632 960 001</>
appelez le <phone>06 12 34 56 78</> ce soir
tél : <phone>01 23 45 67 89</> ou <phone>06.98.76.54.32</>
le <phone>04-72-00-11-22</> est en panne
Telefon <phone>030/5550147</> oder <phone>0170 5550147</>
llame al <phone>91 555 01 47</> o al <phone>612 34 56 78</>
dial <phone>555-0142</> for the desk
call <phone>1-800-555-0199</> now
text <phone>001 415 555 2671</> please
write to <email>ann [at] example [dot] com</> please
mail <email>bob.lee (at) mail.example.org</> now
<email>info [at] example.net</> answers
contact <email>r.23@mail3.example.com</> soon
send it to <email>a_b@example.com</> .
from <email>x.y (at) uni-site (dot) edu</> with love
mail me : <email>jane at example dot com</> thanks
reach <email>john.smith at uni dot edu</> or <email>lee at mail dot example dot org</>
<email>sales at shop dot net</> has it
write <email>jane @ example . com</> today
ask <email>tom AT example DOT org</> first
server <ip>180.194.127.198</> was up
at <ip>10.0.0.1</> and <ip>192.168.2.44</> both
blocked <ip>203[.]0[.]113[.]7</> and <ip>198[.]51[.]100[.]23</> today
seen from <ip>192 . 0 . 2 . 17</> twice
host <ip>2001:db8::1</> answers
from <ip>fe80::1ff:fe23:4567:890a</> to <ip>2001:0db8:85a3:0000:0000:8a2e:0370:7334</>
ping <ip>2001:db8:0:1::25</> or <ip>::1</>
<phone>415-555-2671</>
<phone>020 7946 0958</>
<phone>06 12 34 56 78</>
phone <phone>6505551234</> any time
call <phone>4155552671</> now
call <phone>650 555 1234</> or <phone>650-555-1235</>
<email>jane at example dot com</>
<email>bob [at] example [dot] org</>
<ip>fe80::a1</>
<ip>2001:db8::7:1</>
card <card>4532 0151 1283 0366</> expired
card <card>4532-0151-1283-0366</> on file
pay with <card>4532015112830366</> today
visa <card>4532.0151.1283.0366</> until 05 / 27
amex <card>3782 822463 10005</> , old one <card>4222 222 222 222</>
card no. <card>5555 / 5555 / 5555 / 4444</> please
version 4.0.2.1234 was released on 2024-01-15 at 10:30
in 1999 there were 1,250 of 3.5 million
order 20240115 ref 4785380592391139 paid 12.50
order 4785380592391139 of 2024
the 5927243074273351 of 16 and 6249061645192177 there
license 4.0 of 2020 , page 12 - 15
score 12 - 10 - 8 after 3 rounds
token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff end
key 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde , sum e51a5499e3950eabef3742d6cf40b27b4e61a74a
id 323994846 and 11 22 33 44
rows 1 2 3 4 5 6 7 8 9 10 11 12
values 12 14 15 18 22 27 31
numbers 5 10 15 20 25 30 of 100
from 2001-2003 , 55-60 people [at] the gate (at) noon
in 1998 , 1999 , 2000 and 2001
meet (at) 10 , room 4 [at] home
we look at the dot on the map at noon
the dot com boom at its end
we met at the dot com party , she works at a dot com
he looked at this dot on it
a dot at the end of it , dot or comma
join the dots at 10 or at 12
pages 100-200 and 300-400
pages 112 - 118 , 220 - 225 and 340
ISBN 978-3-16-148410-0 and 3-540-12345-6
dates 01.02.2003 and 12-31-1999
on 12 / 05 / 2021 and 03 / 11 / 2022 at 09:45:30
2024-01-15 10:30:00 INFO 200 5123
2024-01-15T10:30:00 up 99.95
time 10:30:15.250 and 23:59:59
section 3.2.1 , table 4 , 5 and 6
section 1.2.3.4.5 and 7.8.9
sum 100 200 300 and 1 000 000
100 200 300 400 , 150 250 350 450 550
id 1234567890 and 9876543210 of 10
the counts were 100 200 300 400 500 600
1 250 000 people , 3 400 000 cars
12,345,678 or 1.234.567,89
price 19.99 - 24.99 , 100 000 sold
ratio 3:4:5 and 16:9
MAC 00:1a:2b:3c:4d:5e of eth0
std::vector and a::b::c in C
ratio 10::20 of x::y
@ noon @ home @user #1
user @ home . ok at 5
commit 7f3a9c2 and 1b2c3d4e5f
part no. 12-3456-78 , lot 0042-17
zip 90210-1234 , box 12345
coordinates 52.5200 13.4050 and 48.8566 , 2.3522
x = 123456789 ; y = 987654321
case 2019-0123-4567 of the file
1/2 3/4 5/8 7/16
chapter 12 verse 3 , 14 and 15
"""

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_TRIGGER = re.compile(r"[0-9@]|::|[\[({]\s*at\s*[\])}]|\bdot\b", re.I)
#: Characters on both sides of a trigger that are decoded with it at least.
REACH = 32
#: Tokens of a sequence, and those at a cut that the two sequences on both its sides share on each side.
SEQUENCE, MARGIN = 512, 64
STEPS = 200


#: Words that announce a kind, and articles, as shapes of their own.
CUES = {w: kind for kind, cues in {"P": "call phone tel tél telefon fax mobile dial ring number line text appelez llame", "E": "mail email write contact reach send ask", "I": "ip server host ping from blocked", "C": "card visa amex pay mastercard", "D": "the a an this that"}.items() for w in cues.split()}
_HEX = re.compile(r"[a-f]{1,4}")


def shape(token: str, spaced: bool) -> str:
    """The word shape: kind and length of the token, and whether white space comes before it."""
    low = token.lower()
    if token[0].isdigit():
        kind = ("z" if token[0] == "0" else "d") + str(min(len(token), 5) if len(token) < 13 else 9)
    elif low in ("at", "dot"):
        kind = low
    elif low in CUES:
        kind = CUES[low]
    elif _HEX.fullmatch(low):
        kind = "h"
    elif token[0].isalpha():
        kind = "A" if len(token) > 1 else "a"
    else:
        kind = token if ord(token) < 128 else "?"
    return kind + ("_" if spaced else "")


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, shape) of the tokens of text[start:end]."""
    return [(m.start(), m.end(), shape(m[0], m.start() == 0 or text[m.start() - 1].isspace())) for m in _TOKEN.finditer(text, start, end)]


def marked(line: str) -> tuple[str, list[Span]]:
    """A labelled line to its text and spans."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"<(\w+)>(.*?)</>", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


#: Labels: 0 outside, 1 + 2k begins kind k, 2 + 2k continues it.
LABELS = 1 + 2 * len(KINDS)
#: Features of a token: its shape and those of its neighbours.
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)


class CRF:
    def __init__(self, names: dict[tuple[int, str], int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, shapes: list[str]) -> np.ndarray:
        """Emission scores (tokens, labels): the sum over the features that training has seen."""
        return np.array([self.emit[f].sum(0) for f in features(self.names, shapes)]).reshape(-1, LABELS)

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequences of many emission matrices, one numpy step for each position over all of them."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        for k in range(0, len(order), 256):
            part = [i for i in order[k : k + 256] if len(sequences[i])]
            if not part:
                continue
            length = np.array([len(sequences[i]) for i in part])
            width = int(length.max())
            e = np.zeros((len(part), width, LABELS))
            for row, i in enumerate(part):
                e[row, : len(sequences[i])] = sequences[i]
            best, back = e[:, 0] + self.move[LABELS], np.zeros((len(part), width, LABELS), np.int8)
            for t in range(1, width):
                through = best[:, :, None] + self.move[None, :LABELS]
                back[:, t] = through.argmax(1)
                best = np.where((t < length)[:, None], through.max(1) + e[:, t], best)
            label = best.argmax(1)
            path = np.zeros((len(part), width), int)
            for t in range(width - 1, -1, -1):
                path[:, t] = label
                label = np.where(t < length, back[np.arange(len(part)), t, label], label) if t else label
            for row, i in enumerate(part):
                out[i] = path[row, : length[row]]
        return out


def features(names: dict[tuple[int, str], int], shapes: list[str]) -> list[list[int]]:
    n = len(shapes)
    return [[names[o, s] for o in OFFSETS for s in [shapes[i + o] if 0 <= i + o < n else "|"] if (o, s) in names] for i in range(n)]


def _forbidden() -> np.ndarray:
    """Continuing a kind takes its begin or continuation before; row LABELS is the start."""
    bad = np.zeros((LABELS + 1, LABELS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        bad[:, inside] = True
        bad[[inside - 1, inside], inside] = False
    return bad


@lru_cache(maxsize=1)
def train(labelled: str = LABELLED, steps: int = STEPS, rate: float = 0.3, decay: float = 2e-3) -> CRF:
    """Maximum likelihood by gradient ascent with forward and backward sums, L2-regularised; deterministic."""
    data = []
    for line in filter(None, labelled.splitlines()):
        text, spans = marked(line)
        tokens, labels = tokens_of(text, 0, len(text)), []
        for a, b, _ in tokens:
            label = 0
            for kind, s, e in spans:
                if s <= a and b <= e:
                    label = 1 + 2 * KINDS.index(kind) + (a > s)
            labels.append(label)
        data.append(([s for _, _, s in tokens], labels))
    names: dict[tuple[int, str], int] = {}
    for shapes, _ in data:
        for i in range(len(shapes)):
            for o in OFFSETS:
                names.setdefault((o, shapes[i + o] if 0 <= i + o < len(shapes) else "|"), len(names))
    rows = [features(names, shapes) for shapes, _ in data]
    hot = []
    for r in rows:
        x = np.zeros((len(r), len(names)))
        for i, f in enumerate(r):
            x[i, f] = 1
        hot.append(x)
    emit, move, bad = np.zeros((len(names), LABELS)), np.zeros((LABELS + 1, LABELS)), _forbidden()
    mean_e, mean_m = np.zeros_like(emit), np.zeros_like(move)
    for _ in range(steps):
        grad_e, grad_m = -decay * emit, -decay * move
        trans = np.where(bad, -1e9, move)
        for x, (_, labels) in zip(hot, data):
            e = x @ emit
            n = len(labels)
            alpha, beta = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            alpha[0] = e[0] + trans[LABELS]
            for t in range(1, n):
                alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + trans[:LABELS], axis=0) + e[t]
            for t in range(n - 2, -1, -1):
                beta[t] = np.logaddexp.reduce(trans[:LABELS] + (e[t + 1] + beta[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(alpha[-1])
            point = np.exp(alpha + beta - z)
            gold = np.eye(LABELS)[labels]
            grad_e += x.T @ (gold - point) / len(data)
            grad_m[LABELS] += (gold[0] - point[0]) / len(data)
            for t in range(1, n):
                pair = np.exp(alpha[t - 1][:, None] + trans[:LABELS] + (e[t] + beta[t])[None] - z)
                grad_m[:LABELS] -= pair / len(data)
                grad_m[labels[t - 1], labels[t]] += 1 / len(data)
        mean_e, mean_m = 0.9 * mean_e + grad_e, 0.9 * mean_m + grad_m
        emit, move = emit + rate * mean_e, move + rate * mean_m
    return CRF(names, emit, np.where(bad, -1e9, move))


_NUMBERS = re.compile(r"[0-9]+")
_AT = re.compile(r"@|\bat\b", re.I)
_DOT = re.compile(r"\.|\bdot\b", re.I)


def possible(kind: str, value: str) -> bool:
    """Whether a value that the CRF marks can be of its kind at all, whatever it looks like: a phone number has 7 to
    15 digits, a card number 13 to 19 that pass Luhn, an address has something before its "at" and a dot in what
    follows, an IP is four numbers up to 255 or groups of hexadecimal digits for 128 bits."""
    numbers = _NUMBERS.findall(value)
    digits = "".join(numbers)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "email":
        at = _AT.search(value, 1)
        return at is not None and _DOT.search(value, at.end()) is not None
    if ":" in value:
        try:
            IPv6Address(value)
        except ValueError:
            return False
        return True
    return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)


_NONBLANK = re.compile(r"\S*")
_AFTER_AT = re.compile(r"\s*[\w-]+(?:\s*(?:\.|[\[({]\s*dot\s*[\])}]|\bdot\b)\s*[\w-]+)*", re.I)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around the triggers, widened to white space and to the whole domain after an "at", merged where they
    meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low = out[-1][1] if out else 0
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if len(m[0]) > 1:
            domain = _AFTER_AT.match(text, m.end())
            b = max(b, domain.end() if domain else 0)
            k = m.start()
            while k > low and text[k - 1].isspace():
                k -= 1
            a = min(a, max(0, k - 1))
        elif b <= low:
            continue
        while a > low and not text[a - 1].isspace():
            a -= 1
        if b > low and not text[b - 1].isspace():
            b = _NONBLANK.match(text, b).end()
        if out and a <= low:
            out[-1][1] = max(low, b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans_of(part: list[tuple[int, int, str]], labels: np.ndarray) -> Iterator[tuple[int, int, Span]]:
    """(first token, token after the last, span) of each labelled run."""
    t = 0
    while t < len(labels):
        end = t + 1
        if labels[t] % 2 == 1:
            while end < len(labels) and labels[end] == labels[t] + 1:
                end += 1
            yield t, end, (KINDS[(labels[t] - 1) // 2], part[t][0], part[end - 1][1])
        t = end


def crf_spans(crf: CRF, texts: list[str]) -> list[list[Span]]:
    """Spans that the CRF finds in each text, decoded over all texts together.

    Long windows are decoded in sequences that overlap, so that a text of digits alone does not make one batch.  A
    span counts in the sequence that has it at least MARGIN tokens from the cuts on both sides of its start; where it
    reaches the end of that sequence, the window is decoded whole."""
    where, sequences, tokens = [], [], []
    cached: dict[tuple[str, ...], np.ndarray] = {}

    def scores(part: list[tuple[int, int, str]]) -> np.ndarray:
        shapes = tuple(s for _, _, s in part)
        if shapes not in cached:
            cached[shapes] = crf.scores(list(shapes))
        return cached[shapes]

    for i, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        for a, b in windows(text):
            found = tokens_of(text, a, b)
            # With fewer digits and without any of the signs nothing that is possible() can be here.
            numbers = [b - a for a, b, s in found if s[0] in "dz"]
            if sum(numbers) < 7 and len(numbers) < 4 and not any(s.startswith(("at", "@", ":", "dot")) for _, _, s in found):
                continue
            for k in range(0, max(1, len(found) - 2 * MARGIN), SEQUENCE - 2 * MARGIN):
                where.append((i, k, found))
                tokens.append(found[k : k + SEQUENCE])
                sequences.append(scores(tokens[-1]))
    spans: list[list[Span]] = [[] for _ in texts]
    whole: dict[int, tuple[int, list[tuple[int, int, str]]]] = {}
    by_window: dict[int, list[Span]] = defaultdict(list)
    for (i, k, found), part, labels in zip(where, tokens, crf.viterbi(sequences)):
        last = k + SEQUENCE >= len(found)
        whole.setdefault(id(found), (i, found))
        for t, end, span in _spans_of(part, labels):
            if t < (MARGIN if k else 0) or not last and t >= SEQUENCE - MARGIN:
                continue
            by_window[id(found)].append(span if last or end < len(part) else None)
    for key, own in by_window.items():
        i, found = whole[key]
        if None in own:
            own = [s for _, _, s in _spans_of(found, crf.viterbi([crf.scores([s for _, _, s in found])])[0])]
        spans[i] += own
    return spans


def all_spans(crf: CRF, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text.  A CRF span is added if it is possible and meets no base span."""
    base = [base_spans(t) for t in texts]
    out = []
    for text, own, found in zip(texts, base, crf_spans(crf, texts)):
        added = [s for s in found if possible(s[0], text[s[1] : s[2]]) and all(s[2] <= b[1] or b[2] <= s[1] for b in own)]
        out.append((own, ordered([*own, *added])))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are of base spans.

    Null texts count as empty: no spans.  Long texts are read whole.  Repeated rows and null doc_ids are read like
    any other; extra columns are ignored; an empty table gives an empty result."""
    tune(docs.sparkSession)
    crf = train()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for own, every in all_spans(crf, batch.column(1).to_pylist()):
                counts.append([sum(s[0] == k for s in own) for k in KINDS])
                digests.append(sha256(spelled(own).encode()).hexdigest())
                spans.append(spelled(every))
            columns = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; overlapping spans by the first one's."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the personal data of their texts replaced by [kind] and n_chars set to the new length.  Null texts
    stay null; rows without personal data stay as they are."""
    tune(docs.sparkSession)
    crf, names, schema = train(), docs.columns, docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            found = all_spans(crf, [t or "" for t in texts])
            changed = {i: redact_text(texts[i], spans) for i, (_, spans) in enumerate(found) if spans}
            if changed:
                columns = list(batch.columns)
                columns[names.index("text")] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field("text").type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(batch.column(k).to_pylist())], columns[k].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, schema)
