"""Source metrics as column expressions (M1 to M7, M11 to M13): lines, Halstead, McCabe, maintainability, hotspots.

Only block comments are sequential in a file; they are told apart with a running state in one aggregate over the file's lines, so
all metrics stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages with /* */ comments, line comment starts, operators and decision words.
BLOCK_LANGUAGES = ("c", "cpp", "java", "javascript", "typescript", "css")
COMMENT_STARTS = {"python": "#", "ruby": "#", "shell": "#", "perl": "#", "go": "//", "rust": "//", "php": r"//|/\*|\*|#", "css": r"/\*|\*", "html": "<!--", "xml": "<!--"}
C_COMMENTS, ANY_COMMENT = r"//|/\*|\*", r"#|//|/\*"
OPERATORS = "+ - * / % ++ -- = += -= *= /= %= == != < > <= >= && || ! & | ^ ~ << >> ? : ; , . -> ( ) [ ] { }".split()
KEYWORD_OPERATORS = {
    "python": "and or not in is lambda if elif else for while def class import from as try except finally with yield return pass break continue",
    "java": "class interface extends implements public private protected static final abstract synchronized if else for while do switch case default break continue return try catch finally throw throws new instanceof",
    "javascript": "function var let const if else for while do switch case default break continue return try catch finally throw new delete typeof instanceof this =>",
    "cpp": "if else for while do switch case default break continue return goto sizeof struct union enum typedef static extern const volatile auto register",
    "go": "func var const type struct interface if else for switch case default break continue return go select package import defer",
    "rust": "fn let mut const static struct enum trait impl if else for while loop match break continue return pub use mod",
}
KEYWORD_OPERATORS["typescript"] = KEYWORD_OPERATORS["javascript"]
C_LIKE = ("javascript", "typescript", "java", "cpp", "go", "rust", "swift")
DECISIONS = {"python": "if elif for while except with and or"} | dict.fromkeys(C_LIKE, "if for while case catch ? && ||")
OTHER_DECISIONS = "if for while case catch except"
OPERANDS = (r"[a-zA-Z_][a-zA-Z0-9_]*", r"\d+\.?\d*")


def escaped(op: str) -> str:
    return "".join(c if c.isalnum() or c in "<>=!&%-/:;,~" else "\\" + c for c in op)


def line_counts(body: Column, language: str) -> Column:
    """M1: struct of loc_phy, loc_bl, loc_com, loc_pro and comment_ratio."""
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    starts = COMMENT_STARTS.get(language, C_COMMENTS if language in (*C_LIKE, *BLOCK_LANGUAGES) else ANY_COMMENT)
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("blank"), zero.alias("comment"), zero.alias("code"), F.lit(False).alias("inside"))

    def step(s, x):
        blank = x == ""
        opens, closes = (x.contains("/*"), x.contains("*/")) if language in BLOCK_LANGUAGES else (F.lit(False), F.lit(False))
        comment = ~blank & (opens | closes | s["inside"] | x.rlike(f"^({starts})"))
        inside = F.when(blank | (opens & closes), s["inside"]).when(opens, F.lit(True)).when(closes, F.lit(False)).otherwise(s["inside"])
        add = lambda name, c: (s[name] + F.when(c, one).otherwise(zero)).alias(name)
        return F.struct(add("blank", blank), add("comment", comment), add("code", ~blank & ~comment), inside.alias("inside"))

    n = F.size(lines).cast("long")
    return F.aggregate(lines, start, step, lambda s: F.struct(n.alias("loc_phy"), s["blank"].alias("loc_bl"), s["comment"].alias("loc_com"), s["code"].alias("loc_pro"), (100.0 * s["comment"] / n).alias("comment_ratio")))


def stripped(body: Column, language: str) -> Column:
    """Without comments and strings, by the language's rules."""
    steps = [(r"(?m)#.*$", ""), (r'(?s)""".*?"""', ""), (r"(?s)'''.*?'''", "")] if language == "python" else [(r"(?m)//.*$", ""), (r"(?s)/\*.*?\*/", "")] if language in C_LIKE else []
    if steps:
        steps += [(r'"[^"]*"', ""), (r"'[^']*'", "")]
    for pattern, to in steps:
        body = F.regexp_replace(body, pattern, to)
    return body


def operators_of(language: str) -> list[str]:
    return OPERATORS + KEYWORD_OPERATORS.get(language, "").split()


def halstead(files: DataFrame, language: str, body: str = "body") -> DataFrame:
    """M2: files with n1, n2, total_operators, total_operands (lexemes of operators counted as substrings, so those of '+=' count in '+' and '=' too), and
    volume, difficulty, effort, time and bugs."""
    text = F.col("_text")
    df = files.withColumn("_text", stripped(F.col(body), language))
    ops = operators_of(language)
    # counts of single characters and of longer lexemes; matches don't overlap within one operator
    counts = F.array(*(F.regexp_count(text, F.lit(escaped(o))).cast("long") for o in ops))
    df = df.withColumn("_ops", counts)
    strings = [] if language in DECISIONS else [F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)), F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))]
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in OPERANDS), *strings)
    present = F.filter(F.transform(F.arrays_zip(F.array(*map(F.lit, ops)).alias("o"), F.col("_ops").alias("c")), lambda z: F.when(z["c"] > 0, z["o"])), lambda o: o.isNotNull())
    df = df.withColumn("_present", present).withColumn("_found", F.filter(found, lambda w: (w != "")))
    df = df.withColumn("_operands", F.filter("_found", lambda w: ~F.array_contains(F.col("_present"), w)))
    df = df.withColumns({
        "n1": F.size("_present").cast("long"), "total_operators": F.aggregate("_ops", F.lit(0).cast("long"), lambda a, x: a + x),
        "n2": F.size(F.array_distinct("_operands")).cast("long"), "total_operands": F.size("_operands").cast("long"),
    })
    n, total = F.col("n1") + F.col("n2"), F.col("total_operators") + F.col("total_operands")
    df = df.withColumn("volume", F.when((n > 0) & (total > 0), total * F.log2(n.cast("double"))).otherwise(0.0))
    df = df.withColumn("difficulty", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / 2 * (F.col("total_operands") / F.col("n2"))).otherwise(0.0))
    df = df.withColumn("effort", F.col("volume") * F.col("difficulty"))
    df = df.withColumns({"time": F.col("effort") / 18, "bugs": F.pow("effort", F.lit(2.0) / 3) / 3000})
    return df.drop("_text", "_ops", "_present", "_found", "_operands")


def cyclomatic(body: Column, language: str) -> Column:
    """M3: one more than the decision words (whole words) and symbols."""
    text = stripped(body, language)
    out = F.lit(1).cast("long")
    for word in DECISIONS.get(language, OTHER_DECISIONS).split():
        out = out + F.regexp_count(text, F.lit(rf"\b{word}\b" if word.isalpha() else escaped(word))).cast("long")
    return out


def maintainability(volume: Column, complexity: Column, loc: Column, comment_ratio: Column) -> Column:
    """M4, unclamped: 171 - 5.2 ln V - 0.23 G - 16.2 ln LOC + 50 sin sqrt(2.4 c), c in percent."""
    return 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(loc.cast("double"), F.lit(1.0))) + 50 * F.sin(F.sqrt(2.4 * comment_ratio))


def band(mi: Column) -> Column:
    return F.when(mi >= 85, "good").when(mi >= 65, "moderate").when(mi >= 0, "difficult").otherwise("critical")


def clamped(mi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(171.0), mi))


def complexity_score(mi: Column, cyclomatic: Column) -> Column:
    """M5."""
    return 0.6 * F.greatest(F.lit(0.0), 100 - clamped(mi) / 171 * 100) + 0.4 * F.least(2.0 * cyclomatic, F.lit(100.0))


def complexity_class(cyclomatic: Column) -> Column:
    """M6."""
    return F.when(cyclomatic <= 5, "simple").when(cyclomatic <= 10, "moderate").when(cyclomatic <= 20, "complex").otherwise("very_complex")


def file_metrics(files: DataFrame, language: str, body: str = "body") -> DataFrame:
    """files with all of the above."""
    df = halstead(files, language, body).withColumn("_l", line_counts(F.col(body), language)).withColumn("cyclomatic", cyclomatic(F.col(body), language))
    df = df.select("*", "_l.*").drop("_l")
    mi = maintainability(F.col("volume"), F.col("cyclomatic"), F.col("loc_phy"), F.col("comment_ratio"))
    df = df.withColumn("mi_raw", mi)
    return df.withColumns({"mi": clamped(F.col("mi_raw")), "band": band(F.col("mi_raw")), "complexity_score": complexity_score(F.col("mi_raw"), F.col("cyclomatic")), "complexity_class": complexity_class(F.col("cyclomatic"))})


def hotspots(files: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """files(key, complexity_score) with history(key, revisions): churn_score is revisions over the most; risk their mean. The
    reference's formula isn't published, so this one is ours."""
    top = history.agg(F.max("revisions").alias("top"))
    df = files.select(key, "complexity_score").join(history.select(key, "revisions"), key).join(F.broadcast(top))  # one row
    churn = 100.0 * F.col("revisions") / F.col("top")
    risk = 0.5 * churn + 0.5 * F.col("complexity_score")
    return df.select(key, "revisions", F.round(churn, 4).alias("churn_score"), F.round("complexity_score", 4).alias("complexity_score"), F.round(risk, 4).alias("risk_score"), F.when(risk >= 75, "critical").when(risk >= 50, "high").when(risk >= 25, "medium").otherwise("low").alias("risk_level"))


def object_metrics(classes: DataFrame) -> DataFrame:
    """M7: (abstract, classes, ca, ce) with abstractness A, instability I and distance |A + I - 1|."""
    a = F.when(F.col("classes") == 0, 0.0).otherwise(F.col("abstract") / F.col("classes"))
    i = F.when(F.col("ca") + F.col("ce") == 0, 0.0).otherwise(F.col("ce") / (F.col("ca") + F.col("ce")))
    return classes.select("*", F.round(a, 4).alias("abstractness"), F.round(i, 4).alias("instability"), F.round(F.abs(a + i - 1), 4).alias("distance"))
