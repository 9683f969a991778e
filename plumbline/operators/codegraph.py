"""Code graphs of repositories: tags to nodes and typed edges, with imports, calls and base classes resolved.

Every step is an equi-join on (repository, file, name): a module is looked up among all path ends of the files, a name
that a file re-exports is followed hop by hop, and the ways to resolve a use are left joins of which the first that
gives something wins.  Definitions and containment, imports, inheritance, reads and writes are given once each, calls
once for each call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import BUILTINS
from ..functions.text import entity_source, source_lines
from ..tables import materialize

#: Re-exports that are followed, and levels of base classes.
HOPS, ANCESTORS = 4, 12
SELF = ("self", "cls", "super()")


def class_key(file: Column, name: Column) -> Column:
    return F.concat_ws("::class::", file, name)


def function_key(file: Column, name: Column) -> Column:
    return F.concat_ws("::function::", file, name)


def variable_key(file: Column, name: Column) -> Column:
    return F.concat_ws("::var::", file, name)


def _stem(path: Column) -> Column:
    """The base name of a path up to its last dot."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def module_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """files(repo, path), wanted(repo, file, module, level) -> the same with `target`, the file that a Python module
    reference of `file` names: a whole path, a package's, or the shortest path that ends in it; relative references
    climb from the file's folder and take whole paths only.  References without a file are left out."""
    python = files.where(F.endswith("path", F.lit(".py"))).select("repo", "path").distinct()
    parts = F.split("path", "/")
    ends = python.select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("end"), (i == 1).alias("whole")))).alias("e")).select("repo", "path", "e.*")
    keys = ["repo", "file", "module", "level"]
    wanted = wanted.select(*keys).distinct()
    folders = F.filter(F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1), lambda p: ~p.isin("", "."))
    base = F.when(F.col("level") > 0, F.slice(folders, 1, F.greatest(F.size(folders) - (F.col("level") - 1), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    stem = F.array_join(F.concat(base, F.filter(F.split("module", r"\."), lambda p: p != "")), "/")
    ways = F.array(*[F.struct(F.concat(F.col("stem"), F.lit(end)).alias("end"), F.lit(k).alias("way")) for k, end in enumerate((".py", "/__init__.py"))])
    asked = wanted.withColumn("stem", stem).where("stem != '' or level > 0").withColumn("w", F.explode(ways)).select(*keys, "w.*")
    found = asked.join(ends, ["repo", "end"]).where("whole or level = 0")
    rank = F.struct(F.when(F.col("whole"), F.col("way")).otherwise(2).alias("rank"), F.length("path").alias("length"), F.col("path").alias("path"))
    return found.groupBy(*keys).agg(F.min(rank)["path"].alias("target"))


def import_table(files: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names(repo, file, local, target, symbol): what a Python file calls a thing, the file where it is defined and its
    name there (null for a module); and deps(repo, file, dep, pos): the files that a file imports, in order.

    `from p import x` names a submodule if there is one, else a symbol of p; a star names nothing."""
    imports = tags.where("kind = 'import' and file like '%.py' and module is not null").select("repo", "file", "ord", F.col("name").alias("local"), "module", "level", "imported")
    sub = F.when(F.col("imported").isNotNull() & (F.col("imported") != "*"), F.concat(F.when(F.col("module") != "", F.concat("module", F.lit("."))).otherwise(F.lit("")), F.col("imported")))
    imports = imports.withColumn("sub", sub)
    wanted = imports.select("repo", "file", "module", "level").union(imports.where("sub is not null").select("repo", "file", F.col("sub").alias("module"), "level"))
    found = materialize(module_files(files, wanted), "modules")
    own = found.select("repo", "file", "module", "level", F.col("target").alias("package"))
    inner = found.select("repo", "file", F.col("module").alias("sub"), "level", F.col("target").alias("inside"))
    rows = imports.join(own, ["repo", "file", "module", "level"], "left").join(inner, ["repo", "file", "sub", "level"], "left")
    rows = rows.withColumn("target", F.coalesce("inside", "package")).where("target is not null")
    symbol = F.when(F.col("imported").isNotNull() & F.col("inside").isNull(), F.col("imported"))
    last = F.max(F.struct("ord", F.col("target").alias("target"), symbol.alias("symbol")))
    names = rows.where("imported is null or imported != '*'").groupBy("repo", "file", "local").agg(last.alias("r")).select("repo", "file", "local", "r.target", "r.symbol")
    deps = rows.groupBy("repo", "file", F.col("target").alias("dep")).agg(F.min("ord").alias("pos"))
    return names, deps


def definitions(tags: DataFrame) -> DataFrame:
    """(repo, file, kind, name, key) of the classes and functions that are defined."""
    key = F.when(F.col("category") == "class", class_key(F.col("file"), F.col("name"))).otherwise(function_key(F.col("file"), F.col("name")))
    return tags.where("kind = 'def'").select("repo", "file", F.col("category").alias("kind"), "name", key.alias("key")).distinct()


def reachable(defs: DataFrame, names: DataFrame, hops: int = HOPS) -> DataFrame:
    """defs and what files re-export: (repo, file, kind, name, key), a file's own definitions before imported names."""
    links = names.where("symbol is not null").select("repo", F.col("file").alias("_file"), F.col("local").alias("_local"), F.col("target").alias("file"), F.col("symbol").alias("name"))
    out, front = defs, defs
    for _ in range(hops):
        found = links.join(front, ["repo", "file", "name"]).select("repo", F.col("_file").alias("file"), "kind", F.col("_local").alias("name"), "key")
        front = materialize(found.join(defs.select("repo", "file", "kind", "name"), ["repo", "file", "kind", "name"], "left_anti"), "re-exports")
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def _at(via: DataFrame, key: str, **on: str) -> DataFrame:
    """via with its columns renamed for a join, and its key as `key`."""
    return via.select("repo", *[F.col(c).alias(a) for c, a in on.items()], F.col("key").alias(key))


def resolve(uses: DataFrame, defs: DataFrame, via: DataFrame, names: DataFrame, deps: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """uses(repo, file, kind, name, receiver, caller_class, …) with `target`, the key of what is meant, or null.

    First what the receiver names (an imported module or class, a class of the file), then the file's own definition
    for a bare name or self, the name as imported, base classes for self, the file's own definition for other
    receivers, the imported files in order, and last a definition that is the only one of its name in the repository
    and no name of the Python runtime."""
    uses = uses.withColumn("_id", F.xxhash64("repo", "file", "kind", "name", F.coalesce("receiver", F.lit("")), F.coalesce("caller_class", F.lit(""))))
    asked = uses.select("_id", "repo", "file", "kind", "name", "receiver", "caller_class").dropDuplicates(["_id"])
    asked = asked.withColumn("_head", F.regexp_extract("receiver", r"^\s*([^(\[]*?)\s*(?:[(\[].*)?$", 1))
    out = asked.join(names.select("repo", "file", F.col("local").alias("_head"), F.col("target").alias("_hf"), F.col("symbol").alias("_hs")), ["repo", "file", "_head"], "left")
    out = out.join(names.select("repo", "file", F.col("local").alias("name"), F.col("target").alias("_nf"), F.col("symbol").alias("_ns")), ["repo", "file", "name"], "left")
    out = out.withColumn("_nn", F.coalesce("_ns", "name"))
    out = out.join(_at(via, "_module", file="_hf", kind="kind", name="name"), ["repo", "_hf", "kind", "name"], "left")
    classes = via.where("kind = 'class'")
    out = out.join(_at(classes, "_class", file="_hf", name="_hs"), ["repo", "_hf", "_hs"], "left").withColumn("_cf", F.substring_index("_class", "::", 1))
    out = out.join(_at(via, "_method", file="_cf", kind="kind", name="name"), ["repo", "_cf", "kind", "name"], "left")
    out = out.join(_at(defs.where("kind = 'class'"), "_own_class", file="file", name="_head"), ["repo", "file", "_head"], "left")
    out = out.join(_at(defs, "_local", file="file", kind="kind", name="name"), ["repo", "file", "kind", "name"], "left")
    out = out.join(_at(via, "_named", file="_nf", kind="kind", name="_nn"), ["repo", "_nf", "kind", "_nn"], "left")
    seen = asked.select("_id", "repo", "file", "kind", "name", "caller_class")
    if ancestors is not None:
        above = seen.join(ancestors.withColumnRenamed("file", "_pf"), ["repo", "caller_class"]).join(_at(via, "key", file="_pf", kind="kind", name="name"), ["repo", "_pf", "kind", "name"])
        out = out.join(above.groupBy("_id").agg(F.min(F.struct("pos", "key"))["key"].alias("_inherited")), "_id", "left")
    else:
        out = out.withColumn("_inherited", F.lit(None).cast("string"))
    near = seen.join(deps, ["repo", "file"]).join(_at(via, "key", file="dep", kind="kind", name="name"), ["repo", "dep", "kind", "name"])
    out = out.join(near.groupBy("_id").agg(F.min(F.struct("pos", "key"))["key"].alias("_imported")), "_id", "left")
    only = defs.groupBy("repo", "kind", "name").agg(F.count("*").alias("_n"), F.min("key").alias("_only")).where("_n = 1").drop("_n")
    out = out.join(only, ["repo", "kind", "name"], "left")
    bare, own = F.col("receiver").isNull(), F.col("receiver").isin(*SELF)
    runtime = F.col("name").isin(*BUILTINS) & F.endswith("file", F.lit(".py"))
    target = F.coalesce(
        F.when(F.col("_hs").isNull(), F.col("_module")).otherwise(F.col("_method")),
        F.when(F.col("_own_class").isNotNull() & ~bare, F.col("_local")),
        F.when(bare | own, F.col("_local")),
        F.when(bare, F.col("_named")),
        F.when(own, F.col("_inherited")),
        F.col("_local"),
        F.col("_imported"),
        F.when(~runtime, F.col("_only")),
    )
    return uses.join(out.select("_id", target.alias("target")), "_id").drop("_id")


def ancestors_of(inherits: DataFrame) -> DataFrame:
    """inherits(repo, src, dst, ord) of class keys -> (repo, caller_class, file, pos): the files of all classes above a
    class; pos orders them nearest first, a class's own bases before those of its next base.  Cycles end."""
    step = inherits.select("repo", F.col("src").alias("_at"), F.col("dst").alias("_up"), "ord")
    front = inherits.select("repo", F.col("src").alias("caller_class"), F.col("dst").alias("up"), F.array("ord").alias("pos"), F.array("src", "dst").alias("path"))
    out = front = materialize(front, "bases")
    for _ in range(ANCESTORS):
        reached = front.join(step, (front["repo"] == step["repo"]) & (front["up"] == step["_at"])).where(~F.array_contains("path", F.col("_up")))
        front = materialize(reached.select(front["repo"], "caller_class", F.col("_up").alias("up"), F.concat("pos", F.array("ord")).alias("pos"), F.concat("path", F.array("_up")).alias("path")), "bases")
        if front.isEmpty():
            break
        out = out.union(front)
    return out.groupBy("repo", "caller_class", F.substring_index("up", "::", 1).alias("file")).agg(F.min("pos").alias("pos"))


def methods(tags: DataFrame) -> DataFrame:
    """(repo, file, name, class, first): the classes around each function, by their lines."""
    functions = tags.where("kind = 'def' and category = 'function'").select("repo", "file", "name", F.col("first").alias("_first"), F.col("last").alias("_last"))
    classes = tags.where("kind = 'def' and category = 'class'").select("repo", "file", F.col("name").alias("class"), "first", "last")
    return functions.join(classes, ["repo", "file"]).where("_first >= first and _last <= last").select("repo", "file", "name", "class", "first").distinct()


def _other_imports(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Import edges of the languages with braces: by the base name of a header or the first part of a module."""
    rows = tags.where("kind = 'import' and file not like '%.py' and module is not null").select("repo", F.col("file").alias("src"), F.when(F.endswith("file", F.lit(".c")), _stem(F.col("module"))).otherwise(F.substring_index("module", ".", 1)).alias("stem"))
    return rows.join(files.select("repo", F.col("path").alias("dst"), _stem(F.col("path")).alias("stem")), ["repo", "stem"]).select("repo", "src", "dst").distinct()


def build(sources: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sources(repo, path, text), tags of parse_tags -> nodes(repo, id, type, name, relative_path, first, last, ord,
    parent_class, is_attribute) and edges(repo, src, dst, label).

    Files without a tag are no nodes.  A call that resolves to nothing, or to the caller itself, is no edge and makes
    no node."""
    tags = materialize(tags, "tags")
    files = materialize(sources.select("repo", "path").distinct(), "files")
    names, deps = (materialize(t, "imports") for t in import_table(files, tags))
    defs = materialize(definitions(tags), "definitions")
    via = materialize(reachable(defs, names), "reachable")
    around = materialize(methods(tags), "methods")
    parent = around.groupBy("repo", "file", "name").agg(F.max(F.struct("first", "class"))["class"].alias("parent_class"))

    bases = tags.where("kind = 'inherits'").select("repo", "file", F.lit("class").alias("kind"), "name", F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("caller_class"), "owner", "ord")
    inherits = resolve(bases, defs, via, names, deps).where("target is not null").select("repo", class_key(F.col("file"), F.col("owner")).alias("src"), F.col("target").alias("dst"), "ord").where("src != dst")
    inherits = materialize(inherits.groupBy("repo", "src", "dst").agg(F.min("ord").alias("ord")), "inherits")

    calls = tags.where("kind = 'call' and owner is not null").select("repo", "file", F.lit("function").alias("kind"), "name", "receiver", "owner", "ord")
    calls = calls.join(parent.select("repo", "file", F.col("name").alias("owner"), class_key(F.col("file"), F.col("parent_class")).alias("caller_class")), ["repo", "file", "owner"], "left")
    called = resolve(calls, defs, via, names, deps, ancestors_of(inherits)).where("target is not null")
    called = called.select("repo", function_key(F.col("file"), F.col("owner")).alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("label")).where("src != dst")

    uses = tags.where("category = 'var_dependency'").select("repo", function_key(F.col("file"), F.col("owner")).alias("src"), variable_key(F.col("file"), F.col("name")).alias("dst"), F.when(F.col("kind") == "read", "reads").otherwise("writes").alias("label")).distinct()
    parts = [
        defs.select("repo", F.col("file").alias("src"), F.col("key").alias("dst"), F.lit("contains").alias("label")),
        around.select("repo", class_key(F.col("file"), F.col("class")).alias("src"), function_key(F.col("file"), F.col("name")).alias("dst"), F.lit("contains").alias("label")).distinct(),
        deps.select("repo", F.col("file").alias("src"), F.col("dep").alias("dst"), F.lit("imports").alias("label")).join(tags.select("repo", F.col("file").alias("dst")).distinct(), ["repo", "dst"], "left_semi").select("repo", "src", "dst", "label"),
        _other_imports(tags.select("repo", F.col("file").alias("path")).distinct(), tags).withColumn("label", F.lit("imports")),
        inherits.select("repo", "src", "dst", F.lit("inherits_from").alias("label")),
        called,
        uses,
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.union(part)

    none = F.lit(None).cast("string")
    whole = sources.select("repo", F.col("path").alias("file"), F.greatest(F.size(source_lines(F.coalesce("text", F.lit("")))), F.lit(1)).alias("last"))
    of_files = tags.select("repo", "file").distinct().join(whole, ["repo", "file"], "left")
    of_files = of_files.select("repo", F.col("file").alias("id"), F.lit("file").alias("type"), F.substring_index("file", "/", -1).alias("name"), F.col("file").alias("relative_path"), F.lit(1).alias("first"), "last", F.lit(-1).alias("ord"), none.alias("parent_class"), F.lit(None).cast("boolean").alias("is_attribute"))
    first = F.min(F.struct("ord", "first", "last")).alias("r")
    of_defs = tags.where("kind = 'def'").groupBy("repo", "file", "category", "name").agg(first).join(parent, ["repo", "file", "name"], "left")
    key = F.when(F.col("category") == "class", class_key(F.col("file"), F.col("name"))).otherwise(function_key(F.col("file"), F.col("name")))
    of_defs = of_defs.select("repo", key.alias("id"), F.col("category").alias("type"), "name", F.col("file").alias("relative_path"), "r.first", "r.last", "r.ord", F.when(F.col("category") == "function", F.col("parent_class")).alias("parent_class"), F.lit(None).cast("boolean").alias("is_attribute"))
    of_vars = tags.where("category = 'var_dependency'").groupBy("repo", "file", "name").agg(first)
    of_vars = of_vars.select("repo", variable_key(F.col("file"), F.col("name")).alias("id"), F.lit("variable").alias("type"), "name", F.col("file").alias("relative_path"), "r.first", "r.last", "r.ord", none.alias("parent_class"), F.contains("name", F.lit(".")).alias("is_attribute"))
    return of_files.union(of_defs).union(of_vars), edges


def find(nodes: DataFrame, type_: str, name: str, file: str | None = None) -> DataFrame:
    """Nodes of a type and name, of one file if it is given."""
    rows = nodes.where((F.col("type") == type_) & (F.col("name") == name))
    return rows.where(F.col("relative_path") == file) if file else rows


def matches(path: Column, type_: Column, name: Column, q_path: Column, q_type: Column, q_name: Column) -> Column:
    """Whether a node fits a query of path, type (empty for any) and name (null for any)."""
    return (path == q_path) & ((q_type == "") | (type_ == q_type)) & (q_name.isNull() | (name == q_name))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, calls_edges, cross_file_calls, function_nodes, phantom_function_nodes): calls, those between files,
    functions, and functions that nothing contains."""
    calls = edges.where("label = 'calls'").groupBy("repo").agg(F.count("*").alias("calls_edges"), F.count_if(F.substring_index("src", "::", 1) != F.substring_index("dst", "::", 1)).alias("cross_file_calls"))
    held = edges.where("label = 'contains'").select("repo", F.col("dst").alias("id")).distinct().withColumn("_held", F.lit(True))
    functions = nodes.where("type = 'function'").join(held, ["repo", "id"], "left").groupBy("repo").agg(F.count("*").alias("function_nodes"), F.count_if(F.col("_held").isNull()).alias("phantom_function_nodes"))
    return functions.join(calls, "repo", "full").fillna(0)


def export(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One record a node: its place, the source of functions and variables, and what it relates to: files to the files
    that they import, classes to their bases and methods, functions to what they call, read and write, variables to
    the functions that read and write them."""
    named = nodes.select("repo", F.col("id").alias("_id"), F.col("name").alias("_name"))
    out = edges.join(named.withColumnRenamed("_id", "dst"), ["repo", "dst"])
    names = lambda label, name: F.array_sort(F.collect_set(F.when(F.col("label") == label, F.col("_name")))).alias(name)
    down = out.groupBy("repo", F.col("src").alias("id")).agg(names("imports", "related_files"), names("inherits_from", "inheritance"), names("contains", "contains"), names("calls", "calls"), names("reads", "reads"), names("writes", "writes"))
    back = edges.where("label in ('reads', 'writes')").join(named.withColumnRenamed("_id", "src"), ["repo", "src"])
    up = back.groupBy("repo", F.col("dst").alias("id")).agg(names("reads", "accessed_by"), names("writes", "modified_by"))
    rows = nodes.join(down, ["repo", "id"], "left").join(up, ["repo", "id"], "left")
    text = sources.select("repo", F.col("path").alias("relative_path"), "text")
    rows = rows.join(text, ["repo", "relative_path"], "left")
    source = F.when(F.col("type").isin("function", "variable"), entity_source(F.col("text"), F.col("first"), F.col("last")))
    info = F.struct("related_files", "inheritance", F.when(F.col("type") == "class", F.col("contains")).alias("methods"), F.col("parent_class").alias("is_method_of"), "calls", "reads", "writes", "accessed_by", "modified_by")
    return rows.select("repo", "id", "type", "name", F.col("relative_path").alias("filepath"), F.col("first").alias("start_line"), F.col("last").alias("end_line"), source.alias("source"), info.alias("info"))


def loose_callers(tags: DataFrame) -> DataFrame:
    """(repo, name, file, caller): the functions that hold a call of a name, whatever it means."""
    return tags.where("kind = 'call' and owner is not null").select("repo", "name", "file", F.col("owner").alias("caller")).distinct()


def caller_scores(got: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, recall and precision of found callers against true ones, both with `keys`."""
    a, b = got.select(*keys).distinct().withColumn("_got", F.lit(1)), truth.select(*keys).distinct().withColumn("_true", F.lit(1))
    s = a.join(b, keys, "full").agg(F.count_if(F.col("_got").isNotNull() & F.col("_true").isNotNull()).alias("tp"), F.count_if(F.col("_true").isNull()).alias("fp"), F.count_if(F.col("_got").isNull()).alias("fn"))
    rate = lambda n: F.when(n > 0, F.col("tp") / n)
    return s.select("tp", "fp", "fn", rate(F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("tp") + F.col("fp")).alias("precision"))
