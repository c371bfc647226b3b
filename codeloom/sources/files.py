"""Source trees, decision records and repositories."""

from __future__ import annotations

import os
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by extension, and directories that hold no sources.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "scala": "scala", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "css": "css", "html": "html", "sh": "shell", "pl": "perl"}
IGNORED = ("node_modules", "__pycache__", "venv", "env", "build", "dist", "target", "vendor")
LARGEST = 2 * 1024 * 1024


def language(path: Column) -> Column:
    """by extension, null for others."""
    pairs = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def wanted(path: Column) -> Column:
    """No ignored or hidden directory on the way, and a known language."""
    inside = F.concat(F.lit("/"), path)
    return ~inside.rlike(rf"/({'|'.join(IGNORED)}|\.[^/]+|[^/]+\.egg-info|[^/]+-codeql-db)/") & language(path).isNotNull()


def source_files(spark: SparkSession, root: str, largest: int = LARGEST) -> DataFrame:
    """Path below root, mtime, size, content_hash, lang and text of the sources. Size and path are filtered before
    contents are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    df = df.where(F.col("length") <= largest).select(path.alias("filepath"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content").where(wanted(F.col("filepath")))
    text = F.expr("decode(content, 'UTF-8')")
    return df.select("filepath", "mtime", "size", F.md5("content").alias("content_hash"), language(F.col("filepath")).alias("lang"), text.alias("text"))


def body(text: Column, start: Column, end: Column) -> Column:
    """Lines from start to end, from 1, both inclusive."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start.cast("int"), F.greatest(F.lit(0), end - start + 1).cast("int")), "\n")


def counted(path: Column, extensions: tuple[str, ...], bare: tuple[str, ...] = ("Makefile", "Dockerfile", "README", "LICENSE")) -> Column:
    """A file whose extension is among those, or a known one without; hidden files don't count."""
    base = F.substring_index(path, "/", -1)
    suffix = F.lower(base).rlike(r"\.(" + "|".join(extensions) + ")$")
    return ~base.startswith(".") & F.when(base.contains("."), suffix).otherwise(base.isin(*bare))


def decision_records(files: DataFrame) -> DataFrame:
    """Filepath, number and title (the first heading) of markdown records such as 0001-title.md."""
    title = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    number = F.regexp_extract("filepath", r"(\d+)-[^/]*\.md$", 1).try_cast("long")
    return files.where(F.col("filepath").rlike(r"/?\d+-[^/]*\.md$")).select("filepath", number.alias("number"), F.when(title == "", F.col("filepath")).otherwise(title).alias("title"))


def repositories(spark: SparkSession, root: str, depth: int = 3, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, kind) of repositories below root: regular, worktree or bare. Repositories aren't entered, links aren't followed.
    The listing runs on the driver, on its own file system."""
    found, level = [], [root]
    for _ in range(depth + 1):
        below = []
        for d in level:
            try:
                names = sorted(os.listdir(d))
            except OSError:
                continue
            git = os.path.join(d, ".git")
            kind = "regular" if os.path.isdir(git) else "worktree" if os.path.isfile(git) else "bare" if {"HEAD", "objects", "refs"} <= set(names) else None
            if kind:
                name = os.path.basename(d)
                if any(fnmatch(name, g) for g in include) and not any(fnmatch(name, g) for g in exclude):
                    found.append((d, name, kind))
            else:
                below += [p for n in names if not n.startswith(".") and os.path.isdir(p := os.path.join(d, n)) and not os.path.islink(p)]
        level = below
    return spark.createDataFrame(found, "path string, name string, kind string")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(filepath, lang, target) with the file of `files` that each names, if any. Candidates by language come in an order, are
    joined to the listing by equality, and the first that exists is taken."""
    here = F.regexp_replace("filepath", "/?[^/]*$", "")
    join = lambda a, b: F.regexp_replace(F.concat_ws("/", a, b), "^/", "")
    dotted = F.translate(F.regexp_replace("target", r"^\.+", ""), ".", "/")
    relative = F.regexp_replace("target", r"^\./", "")
    options = {
        "python": [F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), F.concat(join(here, dotted), F.lit(".py")), F.concat(join(here, dotted), F.lit("/__init__.py"))],
        "javascript": [join(here, relative), *(F.concat(join(here, relative), F.lit(x)) for x in (".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"))],
        "c": [join(here, F.col("target")), F.col("target"), F.concat(F.lit("include/"), "target"), F.concat(F.lit("src/"), "target")],
        "java": [F.concat(dotted, F.lit(".java")), F.concat(F.lit("src/main/java/"), dotted, F.lit(".java")), F.concat(dotted, F.lit(".kt"))],
        "rust": [F.concat(F.lit("src/"), F.regexp_replace(F.regexp_replace("target", "^crate::", ""), "::", "/"), F.lit(x)) for x in (".rs", "/mod.rs")],
        "go": [F.concat(F.regexp_replace("target", r"^.*?/([^/]+/[^/]+)$", "$1"), F.lit("/doc.go"))],
    }
    same = {"typescript": "javascript", "cpp": "c", "kotlin": "java"}
    lang = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in same.items() for x in kv)), F.col("lang")), F.col("lang"))
    cases = F
    for name, candidates in options.items():
        cases = cases.when(lang == name, F.array(*candidates))
    tried = imports.select("*", F.posexplode(cases.otherwise(F.array(F.col("target")))).alias("rank", "candidate"))
    hit = tried.join(files.select(F.col("filepath").alias("candidate")).distinct(), "candidate")
    best = hit.groupBy("filepath", "lang", "target").agg(F.min_by("candidate", "rank").alias("resolved"))
    return imports.join(best, ["filepath", "lang", "target"], "left")
