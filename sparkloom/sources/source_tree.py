"""Source trees: files with language and hash, configuration facts, frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by language, folders that are never read, marker files and packages of stacks.
LANGUAGES = {"typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "go": ["go"], "rust": ["rs"], "java": ["java"]}
IGNORED = ["node_modules", ".git", "dist", "build", "out", "target", "vendor", "coverage", ".venv", "venv", "__pycache__", ".next"]
MARKERS = [("package.json", "node"), ("tsconfig.json", "typescript"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("pom.xml", "java"), ("build.gradle", "java")]
WORKSPACES = [("pnpm-workspace.yaml", "pnpm"), ("lerna.json", "lerna"), ("nx.json", "nx"), ("turbo.json", "turborepo"), ("go.work", "go")]
FRAMEWORKS = [("react", "React"), ("next", "Next.js"), ("vue", "Vue"), ("@angular/core", "Angular"), ("svelte", "Svelte"), ("express", "Express"), ("fastify", "Fastify"), ("@nestjs/core", "NestJS"), ("django", "Django"), ("flask", "Flask"), ("fastapi", "FastAPI"), ("vitest", "Vitest"), ("jest", "Jest")]


def language_of(path: Column) -> Column:
    """Language by extension, null for others."""
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.lit(None).cast("string")
    for name, known in LANGUAGES.items():
        out = F.when(ext.isin(known), name).otherwise(out)
    return out


def files(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(path relative to root, language, hash, bytes, content) of the source files below root, ignored folders left out.

    The listing is pruned by name before contents are read; the hash is the first 16 hex digits of SHA-256.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", rf"^(?:[a-z]+:/*)?/*{root.strip('/')}/?", "")
    x = raw.select(rel.alias("path"), F.col("length").alias("bytes"), "content").withColumn("language", language_of(F.col("path")))
    ignored = "(^|/)(" + "|".join(i.replace(".", r"\.") for i in IGNORED) + ")/"
    x = x.where(F.col("language").isNotNull() & ~F.col("path").rlike(ignored))
    if languages:
        x = x.where(F.col("language").isin(languages))
    return x.select("path", "language", F.substring(F.sha2("content", 256), 1, 16).alias("hash"), "bytes", F.decode("content", "UTF-8").alias("text"))


def config_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, text) of configuration files below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.json,*.toml,go.mod,.eslintrc*,.prettierrc*,*.yaml}").load(root)
    return raw.select("path", F.substring_index("path", "/", -1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def constraints(configs: DataFrame) -> DataFrame:
    """(path, tool, key, value) facts of known configuration files; files that do not parse give nothing."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?m)(^|\s)//.*$", ""), r",(\s*[}\]])", "$1")
    json = {
        "tsconfig.json": ("tsconfig", {k: f"$.compilerOptions.{k}" for k in ("strict", "target", "module", "baseUrl", "jsx", "noUnusedLocals", "noImplicitAny")}),
        "biome.json": ("biome", {"indentStyle": "$.formatter.indentStyle", "lineWidth": "$.formatter.lineWidth", "quoteStyle": "$.javascript.formatter.quoteStyle", "semicolons": "$.javascript.formatter.semicolons"}),
        ".prettierrc": ("prettier", {k: f"$.{k}" for k in ("semi", "singleQuote", "tabWidth", "printWidth", "trailingComma", "useTabs")}),
        ".eslintrc.json": ("eslint", {"extends": "$.extends", "rules": "$.rules"}),
        "package.json": ("manifest", {k: f"$.{k}" for k in ("name", "type", "main", "module", "bin", "workspaces", "engines.node")}),
    }
    plain = {
        "go.mod": ("go", {"module": r"(?m)^module\s+(\S+)", "go": r"(?m)^go\s+(\S+)"}),
        "Cargo.toml": ("cargo", {"name": r'(?m)^name\s*=\s*"([^"]+)"', "edition": r'(?m)^edition\s*=\s*"([^"]+)"'}),
        "pyproject.toml": ("pyproject", {"name": r'(?m)^name\s*=\s*"([^"]+)"', "requires-python": r'(?m)^requires-python\s*=\s*"([^"]+)"', "line-length": r"(?m)^line-length\s*=\s*(\d+)"}),
    }
    facts = []
    for name, (tool, keys) in json.items():
        facts += [F.when(F.col("name") == name, F.struct(F.lit(tool).alias("tool"), F.lit(k).alias("key"), F.get_json_object(text, p).alias("value"))) for k, p in keys.items()]
    for name, (tool, keys) in plain.items():
        facts += [F.when(F.col("name") == name, F.struct(F.lit(tool).alias("tool"), F.lit(k).alias("key"), F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias("value"))) for k, p in keys.items()]
    return configs.select("path", F.explode(F.filter(F.array(*facts), lambda f: f["value"].isNotNull())).alias("f")).select("path", "f.*")


def entry_files(configs: DataFrame) -> DataFrame:
    """(package, file) that manifests name as entries: main, module, bin and exports."""
    one = F.col("name") == "package.json"
    values = F.concat_ws(" ", *[F.get_json_object("text", f"$.{k}") for k in ("main", "module", "types", "bin", "exports")])
    found = F.regexp_extract_all(values, F.lit(r"(?:\./)?([A-Za-z0-9_@./-]+\.[cm]?[jt]sx?)"), F.lit(1))
    return configs.where(one).select(F.regexp_replace("path", "/[^/]*$", "").alias("package"), F.explode(F.array_distinct(found)).alias("file")).withColumn("file", F.regexp_replace("file", r"^\./", ""))


def stacks(names: DataFrame) -> DataFrame:
    """(kind, name) that marker files prove; names: path."""
    spark = names.sparkSession
    dim = spark.createDataFrame([(f, "stack", s) for f, s in MARKERS] + [(f, "workspace", s) for f, s in WORKSPACES], "file string, kind string, name string")
    base = names.select(F.substring_index("path", "/", -1).alias("file")).distinct()
    return base.join(F.broadcast(dim), "file").select("kind", "name").distinct()


def framework_usage(imports: DataFrame) -> DataFrame:
    """(framework, files) by imported package; imports: src, package."""
    dim = imports.sparkSession.createDataFrame(FRAMEWORKS, "package string, framework string")
    return imports.join(F.broadcast(dim), "package").groupBy("framework").agg(F.countDistinct("src").alias("files"))
