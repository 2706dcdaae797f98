"""From source texts to edges: extraction per file, import and symbol resolution, inheritance, call graph."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import directory
from ..shared import durable, ship
from .graph import bounded
from .parsers import FACTS, parse

#: Confidence of the ways to resolve a call, transmission of aliases, locality of proximity.
DIRECT, MEMBER, NEW, PROXIMITY, ALIAS_HOPS, LEAST_PROXIMITY = 0.95, 0.9, 0.95, 0.5, 5, 0.05
#: Rows of class and base that a single task takes.
MOST_BASES = 1_000_000
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs"]


def extract(files: DataFrame) -> DataFrame:
    """(path, language, imports, symbols, calls, heritage, decorators) of (path, language, text): one pass, one row per file."""
    ship(files.sparkSession)
    names = list(FACTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, lang, *[[*map(tuple, f[k])] for k in names]) for p, lang, t in zip(b.path, b.language, b.text, strict=True) if (f := parse(lang, t)) is not None]
            yield pd.DataFrame(rows, columns=["path", "language", *names])

    return files.select("path", "language", "text").mapInPandas(run, "path string, language string, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in FACTS.items()))


def facts(extracted: DataFrame, kind: str) -> DataFrame:
    """One fact table: path and the columns of ``kind``."""
    return extracted.select("path", "language", F.explode(kind).alias("f")).select("path", "language", "f.*")


def import_candidates(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(path, specifier, candidate, priority): every file that an import may mean, the most likely first.

    Relative specifiers are folded against the importing file's folder; ``aliases`` (prefix, target) stand for path
    mappings and workspace packages: a configuration of a few rows, which is broadcast. Script files probe extensions and index files, Python modules and packages, Java
    source roots, Rust modules.
    """
    s, here = F.col("specifier"), directory(F.col("path"))
    script = F.col("language").isin("typescript", "javascript")
    up = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    parts = F.split(here, "/")
    python_here = F.when(up > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up + 1, F.lit(0))), "/")).otherwise("")
    python_base = F.concat_ws("/", F.nullif(python_here, F.lit("")), F.nullif(F.translate(F.regexp_replace(s, r"^\.+", ""), ".", "/"), F.lit("")))
    base = (
        F.when(script & s.rlike(r"^\.\.?(/|$)"), F.concat_ws("/", here, s)).when(script, s)
        .when(F.col("language") == "python", python_base).when(F.col("language") == "java", F.translate(s, ".", "/"))
        .when((F.col("language") == "rust") & s.startswith("mod::"), F.concat_ws("/", here, F.substring(s, 6, 1 << 20)))
        .when(F.col("language") == "rust", F.concat(F.lit("src/"), F.regexp_replace(F.regexp_replace(s, "^(crate|self|super)::", ""), "::", "/")))
        .otherwise(s)
    )
    x = imports.withColumn("base", base).withColumn("rank0", F.lit(0))
    if aliases is not None:
        a = x.join(F.broadcast(aliases), F.col("specifier").startswith(F.col("prefix"))).withColumn("base", F.concat("target", F.expr("substring(specifier, length(prefix) + 1)"))).drop("prefix", "target").withColumn("rank0", F.lit(10))
        x = x.unionByName(a)
    from ..functions.paths import plain_path

    x = x.withColumn("base", plain_path(F.concat(F.lit("./"), F.col("base"))))
    stem = F.regexp_replace("base", r"\.[cm]?js$", "")
    b = F.col("base")
    options = F.when(script, F.array(b, *[F.concat(stem, F.lit(e)) for e in EXTENSIONS], *[F.concat(b, F.lit(f"/index{e}")) for e in EXTENSIONS])).when(
        F.col("language") == "python", F.array(*[F.concat(F.lit(r), b, F.lit(e)) for r in ("", "src/") for e in (".py", "/__init__.py")])
    ).when(F.col("language") == "java", F.array(*[F.concat(F.lit(r), b, F.lit(".java")) for r in ("", "src/main/java/", "src/", "src/test/java/")])).when(
        F.col("language") == "rust", F.array(F.concat(b, F.lit(".rs")), F.concat(b, F.lit("/mod.rs")), F.concat(directory(b), F.lit(".rs")))
    ).otherwise(F.array(b))
    return x.where("base IS NOT NULL").select(*imports.columns, F.col("rank0"), F.posexplode(options).alias("k", "candidate")).withColumn("priority", F.col("rank0") + F.col("k")).drop("rank0", "k")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Imports with ``target``: the existing file of best priority, null for external ones; files: path."""
    there = import_candidates(imports, aliases).join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = there.groupBy("path", "specifier").agg(F.min_by("candidate", "priority").alias("target"))
    return imports.join(best, ["path", "specifier"], "left").withColumn("is_external", F.col("target").isNull())


def package_of_specifier(specifier: Column, language: Column) -> Column:
    """The package that an external specifier names."""
    scoped = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(language.isin("typescript", "javascript"), scoped).when(language == "python", F.substring_index(specifier, ".", 1)).when(language == "rust", F.substring_index(specifier, "::", 1)).when(language == "java", F.substring_index(specifier, ".", 2)).otherwise(specifier)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, caller, callee, target, tier, confidence): the symbol a call means, by the surest of three ways.

    1: a symbol of the same file; 2: a name that the file imports from the target; 3: a member of an imported or
    constructed object's file. ``symbols``: path, name, kind; ``imports``: path, target, names.
    """
    s = symbols.select(F.col("path").alias("target"), F.col("name").alias("callee")).distinct()
    own = calls.join(s.withColumn("path", F.col("target")), ["path", "callee"]).withColumns({"tier": F.lit(1), "confidence": F.lit(DIRECT)})
    named = imports.where("target IS NOT NULL").select("path", "target", F.explode("names").alias("name"))
    by_name = calls.join(named.withColumnRenamed("name", "callee"), ["path", "callee"]).join(s, ["target", "callee"], "left_semi").withColumns({"tier": F.lit(2), "confidence": F.when(F.col("is_new"), NEW).otherwise(DIRECT)})
    star = named.withColumn("object", F.regexp_replace("name", r"^\* as ", "")).drop("name")
    member = calls.where("object IS NOT NULL").join(star, ["path", "object"]).join(s, ["target", "callee"], "left_semi").withColumns({"tier": F.lit(3), "confidence": F.lit(MEMBER)})
    columns = ["path", "caller", "callee", "object", "line", "is_new", "target", "tier", "confidence"]
    every = own.select(*columns).unionByName(by_name.select(*columns)).unionByName(member.select(*columns))
    first = W.partitionBy("path", "caller", "callee", "object", "line").orderBy("tier", "target")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def proximity(unresolved: DataFrame, candidates: DataFrame, neighbours: DataFrame, least: float = LEAST_PROXIMITY) -> DataFrame:
    """Best guess for calls that nothing resolved: smoothed shared neighbours · authority^.5 · locality.

    ``unresolved``: path, caller, callee; ``candidates``: target, callee, authority; ``neighbours``: path, near (array).
    Locality is 10 in the same folder, 2 below the same top folder, else 1.
    """
    from ..functions.arrays import smoothed_jaccard

    n = lambda x: neighbours.select(F.col("path").alias(x), F.col("near").alias(f"near_{x}"))
    x = unresolved.join(candidates, "callee").where("path <> target").join(n("path"), "path").join(n("target"), "target")
    local = F.when(directory(F.col("path")) == directory(F.col("target")), 10.0).when(F.substring_index("path", "/", 1) == F.substring_index("target", "/", 1), 2.0).otherwise(1.0)
    score = smoothed_jaccard(F.col("near_path"), F.col("near_target")) * F.sqrt(F.greatest("authority", F.lit(0.0))) * local
    best = x.withColumn("score", score).where(F.col("score") >= least).groupBy("path", "caller", "callee").agg(F.max_by(F.struct("target", "score"), F.struct("score", "target")).alias("b"))
    return best.select("path", "caller", "callee", "b.target", "b.score").withColumn("confidence", F.lit(PROXIMITY))


def follow_aliases(names: DataFrame, aliases: DataFrame, hops: int = ALIAS_HOPS) -> DataFrame:
    """``names`` (name) with ``real``: what a chain of at most ``hops`` aliases (alias, name) ends in."""
    a = aliases.groupBy("alias").agg(F.min("name").alias("next"))
    x = names.select("name").distinct().withColumn("real", F.col("name"))
    for _ in range(hops):
        x = x.join(a.withColumnRenamed("alias", "real"), "real", "left").select("name", F.coalesce("next", "real").alias("real"))
    return names.join(x, "name")


def satisfied_interfaces(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(type, interface): types that have every method of a non-empty interface; methods: type, method; interfaces: interface, method.

    Relational division: shared methods are counted and compared with the interface's size.
    """
    need = interfaces.distinct()
    size = need.groupBy("interface").agg(F.count("*").alias("size"))
    have = methods.select("type", "method").distinct().join(need, "method").groupBy("type", "interface").agg(F.count("*").alias("n"))
    return have.join(size, "interface").where("n = size").select("type", "interface")


def linearise(bases: DataFrame) -> DataFrame:
    """(graph_id, class, place, ancestor): method resolution order (C3) of every class; classes without one give nothing.

    ``bases``: graph_id, class, base, position. One task per graph of classes, of up to MOST_BASES rows; more are an error.
    """
    ship(bases.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, list[str]] = {}
        for r in pdf.sort_values(["class", "position"]).itertuples(index=False):
            parents.setdefault(r[1], []).append(r[2])
        known: dict[str, list[str] | None] = {}

        def order(c: str, seen: tuple = ()) -> list[str] | None:
            if c in seen:
                return None
            if c not in known:
                lists = [order(p, (*seen, c)) for p in parents.get(c, [])]
                if any(x is None for x in lists):
                    return None
                todo, out = [list(x) for x in [*lists, parents.get(c, [])] if x], [c]
                while todo:
                    head = next((x[0] for x in todo if not any(x[0] in y[1:] for y in todo)), None)
                    if head is None:
                        out = None
                        break
                    out.append(head)
                    todo = [y for y in ([z for z in x if z != head] for x in todo) if y]
                known[c] = out
            return known[c]

        rows = [(pdf.graph_id.iloc[0], c, i, a) for c in sorted(parents) for i, a in enumerate(order(c) or [])]
        return pd.DataFrame(rows, columns=["graph_id", "class", "place", "ancestor"])

    kept = bounded(bases.select("graph_id", "class", "base", "position"), ["graph_id"], MOST_BASES, "bases")
    return kept.groupBy("graph_id").applyInPandas(run, "graph_id string, `class` string, place int, ancestor string")


def call_graph(resolved: DataFrame) -> DataFrame:
    """(src, dst, caller, callee, calls, confidence): distinct calls between symbols of files."""
    return resolved.groupBy(F.col("path").alias("src"), F.col("target").alias("dst"), "caller", "callee").agg(F.count("*").alias("calls"), F.max("confidence").alias("confidence"))


def event_edges(emits: DataFrame, handles: DataFrame, most: int = 50) -> DataFrame:
    """Edges from emitters to handlers of the same event, at most ``most`` per emitter in order of handler; both path, event."""
    x = emits.withColumnRenamed("path", "src").join(handles.withColumnRenamed("path", "dst"), "event").where("src <> dst")
    return x.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("dst", "event"))).where(F.col("n") <= most).drop("n")


def symbol_authority(edges: DataFrame, inner_calls: DataFrame) -> DataFrame:
    """(file, name, authority): weighted in-degree plus .3 per call inside the file, over the file's greatest, to 3 digits.

    ``edges``: file, name, weight (of the called symbol); ``inner_calls``: file, name.
    """
    s = edges.select("file", "name", "weight").unionByName(inner_calls.select("file", "name", F.lit(0.3).alias("weight"))).groupBy("file", "name").agg(F.sum("weight").alias("w"))
    return s.withColumn("authority", F.round(F.col("w") / F.max("w").over(W.partitionBy("file")), 3)).drop("w")


#: Imports below which a file has no order.
LEAST_IMPORTS = 3
_IMPORT_LINE = re.compile(r"^import\s+(?:.*?\s+from\s+)?['\"]([^'\"]+)['\"]")


def _import_order(text: str | None) -> tuple[str | None, bool, bool]:
    """(order, alphabetical, built-ins apart) of the import lines that open a script file."""
    lines, gap = [], False  # (specifier, group, is_builtin, a blank line stands before)
    for line in map(str.strip, (text or "").split("\n")):
        if not line:
            gap = bool(lines)
        elif m := _IMPORT_LINE.match(line):
            s = m[1]
            group = "internal" if s.startswith(("@/", "~/")) else "relative" if s.startswith(".") else "external"
            lines.append((s, group, s.startswith("node:"), gap))
            gap = False
        elif lines and not line.startswith("import"):
            break
    if len(lines) < LEAST_IMPORTS:
        return None, False, False
    groups = [g for _, g, _, _ in lines]
    first = "external" in groups and ("relative" not in groups or groups.index("external") < groups.index("relative"))
    order = ("external-first, blank-line separated" if any(b for *_, b in lines) else "external-first") if first else None
    within = [(a, b) for a, b in zip(lines, lines[1:], strict=False) if a[1] == b[1] and not b[3]]
    alphabetical = all(a[0].lower() <= b[0].lower() for a, b in within)
    borders = [b[3] for a, b in zip(lines, lines[1:], strict=False) if a[1] == b[1] == "external" and a[2] != b[2]]
    return order, alphabetical, bool(borders) and borders[0]


def import_order(files: DataFrame) -> DataFrame:
    """(path, ordering, alphabetical, builtins_apart) of (path, text): how the imports at the head of a script file are sorted.

    External ones first or not, with blank lines between groups or not; alphabetical inside each group, case aside; built-in
    modules apart from other external ones by a blank line. Files of under three imports and null texts have no order.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *_import_order(t)) for p, t in zip(b.path, b.text, strict=True)], columns=["path", "ordering", "alphabetical", "builtins_apart"])

    return files.select("path", "text").mapInPandas(run, "path string, ordering string, alphabetical boolean, builtins_apart boolean")


def _signature(lines: list[str], start: int, colon: bool, most: int = 20) -> str:
    """The declaration of a symbol: its lines up to where the body opens, blanks folded."""
    head = " ".join(x.strip() for x in lines[start - 1 : start - 1 + most])
    depth = 0
    for i, c in enumerate(head):
        depth += (c in "([") - (c in ")]")
        if depth <= 0 and ((c == ":" and colon) or (c in "{;" and not colon)):
            head = head[:i]
            break
    return re.sub(r"\s+", " ", head).strip()


def signatures(files: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, is_exported, signature, hash) of the symbols of (path, language, text): a snapshot of what a file offers.

    The hash changes only with the signature, so that two snapshots tell changed interfaces from changed bodies.
    """
    ship(files.sparkSession)
    columns = ["path", "name", "kind", "start_line", "is_exported", "signature", "hash"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, text in zip(b.path, b.language, b.text, strict=True):
                lines = (text or "").split("\n")
                for name, kind, start, _, exported, *_ in (parse(lang, text) or {}).get("symbols", []):
                    s = _signature(lines, start, lang == "python")
                    rows.append((p, name, kind, start, exported, s, hashlib.sha256(s.encode()).hexdigest()[:16]))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "language", "text").mapInPandas(run, "path string, name string, kind string, start_line int, is_exported boolean, signature string, hash string")


def symbol_pipeline(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, caller, dst, callee, calls, tier, confidence): the call graph in two passes.

    First the sure ways of resolve_calls; the calls found give every file its neighbours and every symbol its authority.
    Second, calls that nothing resolved are given to the nearest symbol of that name by proximity (tier 5). ``calls``: path,
    caller, callee, object, line, is_new; ``symbols``: path, name, kind; ``imports``: path, target, names.
    """
    sure = durable(resolve_calls(calls, symbols, imports))
    strong = sure.where("path <> target").groupBy(F.col("path").alias("file"), F.col("target").alias("to"), F.col("callee").alias("name")).agg(F.count("*").cast("double").alias("weight"))
    authority = symbol_authority(strong.select(F.col("to").alias("file"), "name", "weight"), sure.where("path = target").select(F.col("target").alias("file"), F.col("callee").alias("name")))
    links = strong.select("file", "to").unionByName(strong.select(F.col("to").alias("file"), F.col("file").alias("to")))
    every = symbols.select(F.col("path").alias("file")).unionByName(calls.select(F.col("path").alias("file"))).distinct()
    near = every.join(links.groupBy("file").agg(F.array_sort(F.collect_set("to")).alias("near")), "file", "left").select(F.col("file").alias("path"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    key = ["path", "caller", "callee", "line"]
    open_calls = calls.select(*key).distinct().join(sure.select(*key).distinct(), key, "left_anti")
    named = symbols.select(F.col("path").alias("target"), F.col("name").alias("callee")).distinct()
    scored = named.join(authority.select(F.col("file").alias("target"), F.col("name").alias("callee"), "authority"), ["target", "callee"], "left").select("target", "callee", F.coalesce("authority", F.lit(0.0)).alias("authority"))
    guessed = proximity(open_calls.select("path", "caller", "callee").distinct(), scored, near).withColumn("tier", F.lit(5))
    both = sure.select("path", "caller", "target", "callee", "tier", "confidence").unionByName(guessed.select("path", "caller", "target", "callee", "tier", "confidence"))
    return both.groupBy(F.col("path").alias("src"), "caller", F.col("target").alias("dst"), "callee").agg(F.count("*").alias("calls"), F.min("tier").alias("tier"), F.max("confidence").alias("confidence"))
