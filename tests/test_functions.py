import math
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import metrics as M
from codeloom.functions import naming as N

NAMES = {
    "rowCount": ("camelCase", "", "", False), "RowCount": ("PascalCase", "", "", False), "row_count": ("snake_case", "", "", False), "LEAST_SEEN_AT": ("SCREAMING_SNAKE_CASE", "", "", False),
    "row-count": ("kebab-case", "", "", False), "Row-Count": ("Train-Case", "", "", False), "ROW-COUNT": ("COBOL-CASE", "", "", False), "rowcount": ("flatcase", "", "", False), "ROWCOUNT": ("UPPERFLATCASE", "", "", False),
    "net.http.cookies": ("dot.case", "", "", False), "m_rows": ("flatcase", "m_", "", False), "_hiddenTotal": ("camelCase", "_", "", False), "rows_": ("flatcase", "", "_", False), "m_row_count": ("snake_case", "m_", "", False),
    "kLimit": ("PascalCase", "k", "", False), "IReader": ("PascalCase", "I", "", False), "TQueue": ("PascalCase", "T", "", False), "__enter__": ("flatcase", "__", "__", True), "": ("unknown", "", "", False),
}


def test_names(spark):
    got = N.analyse(spark.createDataFrame([(n,) for n in [*NAMES, None]], "raw string")).collect()
    assert {r["raw"]: (r["case_style"], r["prefix"], r["suffix"], r["is_magic"]) for r in got if r["raw"] is not None} == NAMES
    assert [(r["intent"], r["canonical_verb"], list(r["tokens"])) for r in got if not r["raw"]] == [("unknown", "unknown", [])] * 2


@pytest.mark.parametrize("tokens, verb, entity", [(["get", "order", "for", "day"], "retrieve", "order"), (["fetch", "order", "by", "day"], "retrieve", "order"), (["save", "row"], "persist", "row"), (["insert"], "persist", "unknown"), (["rows", "list"], "unknown", "row"), (["with", "id"], "unknown", "with")])
def test_canonical(spark, tokens, verb, entity):
    df = spark.createDataFrame([(tokens,)], "t array<string>").select(N.canonical_verb(F.col("t")).alias("v"), N.canonical_entity(F.col("t")).alias("e"))
    assert tuple(df.first()) == (verb, entity)


def test_grammar_and_domain(spark):
    rows = [("getByRowCount", "src/auth/x.py"), ("byTheWay", "a/myauth.py"), ("x", "billing/a/b"), ("isOk", "a/config/b"), ("run", "")]
    got = {r["raw"]: r for r in N.analyse(spark.createDataFrame(rows, "raw string, p string"), path="p").collect()}
    assert (got["getByRowCount"]["verb"], got["getByRowCount"]["entity"], got["getByRowCount"]["qualifier"]) == ("get", "row", "count")
    assert (got["byTheWay"]["verb"], got["byTheWay"]["entity"]) == (None, "the")
    assert [got[k]["domain"] for k in ("getByRowCount", "byTheWay", "x", "isOk", "run")] == ["auth", "auth", "core", "infra", "unknown"]
    assert got["isOk"]["intent"] == "validation"


CODE = '''/* head
 body */
int a = b + 1; // tail
/* one */ x;

if (a && b) { a += "s + t"; }
/* open
still
*/ end
'''


def test_lines_and_block_comments(spark):
    x = spark.createDataFrame([(CODE,)], "body string").select(M.line_counts(F.col("body"), "java").alias("l")).first()["l"]
    assert (x["loc_phy"], x["loc_bl"], x["loc_com"], x["loc_pro"]) == (10, 2, 6, 2)
    y = spark.createDataFrame([("# c\nx = 1  # t\n\n",)], "body string").select(M.line_counts(F.col("body"), "python").alias("l")).first()["l"]
    assert (y["loc_phy"], y["loc_bl"], y["loc_com"], y["loc_pro"]) == (4, 2, 1, 1)


@pytest.mark.parametrize("language, body", [("java", CODE), ("python", "def f(x):\n    '''doc'''\n    return x if x and 'a' else -x ** 2  # c\n"), ("text", "a b a 'q' 3.5 -> ++\n")])
def test_halstead_equals_counting(spark, language, body):
    r = M.file_metrics(spark.createDataFrame([(body,)], "body string"), language).first()
    text = body
    if language == "python":
        for p, flags in ((r"#.*$", re.M), (r'""".*?"""', re.S), (r"'''.*?'''", re.S), (r'"[^"]*"', 0), (r"'[^']*'", 0)):
            text = re.sub(p, "", text, flags=flags)
    elif language == "java":
        for p, flags in ((r"//.*$", re.M), (r"/\*.*?\*/", re.S), (r'"[^"]*"', 0), (r"'[^']*'", 0)):
            text = re.sub(p, "", text, flags=flags)
    ops = {o: text.count(o) for o in M.operators_of(language) if o in text}
    words = [w for p in (r"[a-zA-Z_][a-zA-Z0-9_]*", r"\d+\.?\d*", r'"([^"]*)"', r"'([^']*)'") for w in re.findall(p, text) if w and w not in ops]
    assert (r["n1"], r["total_operators"], r["n2"], r["total_operands"]) == (len(ops), sum(ops.values()), len(set(words)), len(words))
    n, total = r["n1"] + r["n2"], r["total_operators"] + r["total_operands"]
    assert math.isclose(r["volume"], total * math.log2(n)) and math.isclose(r["time"], r["effort"] / 18) and math.isclose(r["bugs"], r["effort"] ** (2 / 3) / 3000)
    assert r["band"] in ("good", "moderate", "difficult", "critical") and 0 <= r["mi"] <= 171


def test_empty_file(spark):
    r = M.file_metrics(spark.createDataFrame([("",)], "body string"), "java").first()
    assert (r["volume"], r["difficulty"], r["cyclomatic"], r["loc_phy"], r["loc_bl"]) == (0, 0, 1, 1, 1)


def test_complexity_bands(spark):
    got = spark.createDataFrame([(x,) for x in (5, 6, 10, 20, 21)], "c long").select(M.complexity_class(F.col("c"))).collect()
    assert [r[0] for r in got] == ["simple", "moderate", "moderate", "complex", "very_complex"]
