"""Guessed edges that no import shows: injection, routes, trait bounds, descriptors; and method calls of Rust types.

All are joins of the fact tables of ``extraction.facts``: symbols (path, name, kind, start_line, end_line), decorators (path,
target, name), calls (path, caller, object, callee, line), and of resolved imports (path, name, target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import durable

#: Confidence of a guess, decorators of injected classes and of routes, calls that register routes.
GHOST = 0.6
INJECTED = ["Injectable", "Controller", "Module", "Component", "Service", "inject", "Inject", "Autowired", "Repository"]
ROUTES, ROUTE_CALLS, MIDDLEWARE = ["Get", "Post", "Put", "Delete", "Patch"], ["get", "post", "put", "delete", "patch"], "use"
#: Traits of the standard library, which say nothing about a project.
COMMON_TRAITS = """Clone Copy Debug Default Display Drop Eq PartialEq Ord PartialOrd Hash Send Sync Unpin Sized From Into TryFrom TryInto AsRef AsMut Borrow BorrowMut
Iterator IntoIterator FromIterator Add Sub Mul Div Rem Neg Deref DerefMut Index IndexMut Fn FnMut FnOnce""".split()
DEREF_HOPS = 3
_OUT = ["src", "src_name", "dst", "dst_name", "kind", "confidence", "line"]


def _edges(df: DataFrame, src: str, src_name: str, dst: str, dst_name: str, kind: str, line: str) -> DataFrame:
    return df.select(*[F.col(c).alias(o) for c, o in zip((src, src_name, dst, dst_name), _OUT, strict=False)], F.lit(kind).alias("kind"), F.lit(GHOST).alias("confidence"), F.col(line).alias("line")).distinct()


def _inside(line: Column, start: Column, end: Column) -> Column:
    """Whether a line lies in a block; an unknown end leaves it open."""
    return (line >= start) & (line <= F.coalesce(end, F.lit((1 << 31) - 1)))


def injected(decorators: DataFrame, uses: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """From a class with a decorator of injection to each imported class or struct among the types it uses; uses: path, name, type, line."""
    marked = decorators.where(F.col("name").isin(INJECTED)).select("path", F.col("target").alias("name")).distinct()
    bound = uses.join(marked, ["path", "name"], "left_semi").join(imports.select("path", F.col("name").alias("type"), F.col("target").alias("file")).where("file IS NOT NULL"), ["path", "type"])
    solid = symbols.where(F.col("kind").isin("class", "struct")).select(F.col("path").alias("file"), F.col("name").alias("type")).distinct()
    return _edges(bound.join(solid, ["file", "type"], "left_semi"), "path", "name", "file", "type", "di_inject", "line")


def routes(decorators: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """From route methods to the controller class around them, and from middleware to the handlers on the same router."""
    marked = lambda names, alias: decorators.where(F.col("name").isin(names)).select("path", F.col("target").alias(alias)).distinct()
    classes = symbols.where("kind = 'class'").select("path", F.col("name").alias("class"), F.col("start_line").alias("from"), F.col("end_line").alias("to")).join(marked(["Controller"], "class"), ["path", "class"], "left_semi")
    methods = symbols.where("kind = 'method'").select("path", F.col("name").alias("method"), "start_line").join(marked(ROUTES, "method"), ["path", "method"], "left_semi")
    own = methods.join(classes, "path").where(_inside(F.col("start_line"), F.col("from"), F.col("to")))
    sites = calls.where("object IS NOT NULL AND caller IS NOT NULL").select("path", "object", "callee", "caller", "line")
    before = sites.where(F.col("callee") == MIDDLEWARE).drop("callee")
    after = sites.where(F.col("callee").isin(ROUTE_CALLS)).select("path", "object", F.col("caller").alias("handler")).distinct()
    chained = before.join(after, ["path", "object"]).where("caller <> handler")
    return _edges(own, "path", "method", "path", "class", "route", "start_line").unionByName(_edges(chained, "path", "caller", "path", "handler", "route", "line"))


def trait_bounds(impls: DataFrame, symbols: DataFrame) -> DataFrame:
    """From a type to each trait it implements, the standard library's aside; impls: path, type, trait, method (one row a method).

    A trait name that several files define means the first file by path. The type must be defined in the file of its impl.
    """
    wanted = impls.where(F.col("trait").isNotNull() & ~F.col("trait").isin(COMMON_TRAITS)).select("path", "type", "trait").distinct()
    where = symbols.where("kind = 'trait'").groupBy(F.col("name").alias("trait")).agg(F.min("path").alias("file"))
    known = symbols.groupBy("path", F.col("name").alias("type")).agg(F.min("start_line").alias("line"))
    return _edges(wanted.join(known, ["path", "type"]).join(where, "trait"), "path", "type", "file", "trait", "trait_bound", "line")


def descriptors(symbols: DataFrame, made: DataFrame, imports: DataFrame) -> DataFrame:
    """From the owner of an assignment to the descriptor class it makes; made: path, variable, class, owner (null: module level), line.

    A class is a descriptor if a function __get__ or __set__ lies inside it; it must be of the same file or be imported from
    the file it comes from.
    """
    hooks = symbols.where(F.col("kind").isin("method", "function") & F.col("name").isin("__get__", "__set__")).select("path", F.col("start_line").alias("at"))
    classes = symbols.where("kind = 'class'").join(hooks, "path").where(_inside(F.col("at"), F.col("start_line"), F.col("end_line"))).select(F.col("path").alias("file"), F.col("name").alias("class")).distinct()
    local = made.withColumn("file", F.col("path")).join(classes, ["file", "class"], "left_semi")
    far = made.join(imports.select("path", F.col("name").alias("class"), F.col("target").alias("file")).where("file IS NOT NULL AND file <> path"), ["path", "class"]).join(classes, ["file", "class"], "left_semi")
    both = local.unionByName(far).withColumn("who", F.coalesce("owner", "variable"))
    return _edges(both, "path", "who", "file", "class", "descriptor", "line")


def rust_methods(calls: DataFrame, impls: DataFrame, derefs: DataFrame, symbols: DataFrame, imports: DataFrame, hops: int = DEREF_HOPS) -> DataFrame:
    """(path, caller, callee, line, type, target, hops): the type and file whose method a call on a Rust type means.

    ``calls``: path, caller, object (the type), callee, line; ``impls``: type, trait (null: the type's own), method;
    ``derefs``: type, to; ``imports``: path, name. A type's own methods come before those of traits that the calling file
    imports, and these before the type it derefs to, up to ``hops`` times; of several the first by path.
    """
    home = durable(symbols.where(F.col("kind").isin("struct", "enum", "trait")).groupBy(F.col("name").alias("type")).agg(F.min("path").alias("target")))
    own = impls.where("trait IS NULL").select("type", F.col("method").alias("callee")).distinct()
    of_trait = impls.where("trait IS NOT NULL").select("type", F.col("method").alias("callee"), F.col("trait").alias("name")).distinct()
    next_type = derefs.groupBy("type").agg(F.min("to").alias("to"))
    seen = imports.select("path", "name").distinct()
    todo = calls.where("object IS NOT NULL").select("path", "caller", "callee", "line", F.col("object").alias("type"), F.col("object").alias("object")).distinct()
    key, found = ["path", "caller", "callee", "line", "object"], None
    for k in range(hops + 1):
        todo = durable(todo)
        named = todo.join(own, ["type", "callee"], "left_semi").unionByName(todo.join(of_trait, ["type", "callee"]).join(seen, ["path", "name"], "left_semi").drop("name")).distinct()
        hit = named.join(home, "type").select("path", "caller", "callee", "line", "object", "type", "target", F.lit(k).alias("hops"))
        found = hit if found is None else found.unionByName(hit)
        todo = todo.join(hit.select(*key), key, "left_anti").join(next_type, "type").select("path", "caller", "callee", "line", F.col("to").alias("type"), "object")
    return found.drop("object")


def deref_edges(derefs: DataFrame, symbols: DataFrame) -> DataFrame:
    """From a wrapper type to the type it derefs to, both of known files."""
    home = symbols.where(F.col("kind").isin("struct", "enum", "trait")).groupBy("name").agg(F.min("path").alias("file"))
    of = lambda name, file: home.select(F.col("name").alias(name), F.col("file").alias(file))
    both = derefs.select("type", "to").distinct().join(of("type", "a"), "type").join(of("to", "b"), "to")
    return both.select(F.col("a").alias("src"), F.col("type").alias("src_name"), F.col("b").alias("dst"), F.col("to").alias("dst_name"), F.lit("rust:deref_coercion").alias("kind"))
