"""Identifier analysis as column expressions (F1 to F8): affixes, case style, words, grammar, canonical forms, domain, intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the naming rules.
PREFIXES = ("m_", "g_", "s_", "k_", "__", "_")
TYPE_PREFIXES = "ICTEk"
SUFFIXES = ("_impl", "_t", "_v", "_")
VERBS = "get fetch load query find read retrieve set put update patch create make new build construct init delete remove drop destroy clear is has can should will does save store write persist insert validate check ensure parse format".split()
STOP_WORDS = "by with for of and or to in on".split()
NOISY = "id type status state list array".split()
SYNONYMS = {
    "retrieve": "get fetch load query find read select", "persist": "save store write persist insert upsert", "update": "set put update patch",
    "create": "create make build new", "delete": "delete remove drop clear destroy", "check": "is has can should validate verify",
}
INTENTS = {"retrieve": "query", "persist": "mutation", "create": "mutation", "update": "mutation", "delete": "mutation", "check": "validation", "validate": "validation"}
ENTITY_ENDS = "info|data|record|model|repository|service|controller|handler"
DOMAINS = (("auth", r"/auth|auth[^/]*$"), ("payment", r"/pay|/billing"), ("user", r"/user|/account"), ("infra", r"/infra|/config"))


def _among(x: Column, words) -> Column:
    return x.isin(*words)


def affixes(raw: Column) -> dict[str, Column]:
    """core, prefix, suffix and is_magic of an identifier."""
    magic = raw.rlike(r"(?s)^__.+__$")
    prefix = F.regexp_extract(raw, f"^({'|'.join(PREFIXES)})", 1)
    typed = F.regexp_extract(raw, rf"(?s)^([{TYPE_PREFIXES}])\p{{Lu}}.", 1)
    prefix = F.when(prefix != "", prefix).otherwise(typed)
    rest = F.substr(raw, F.length(prefix) + 1, F.length(raw))
    suffix = F.regexp_extract(rest, f"({'|'.join(SUFFIXES)})$", 1)
    core = F.substr(rest, F.lit(1), F.length(rest) - F.length(suffix))
    return {
        "core": F.when(magic, F.substr(raw, F.lit(3), F.length(raw) - 4)).otherwise(core), "prefix": F.when(magic, "__").otherwise(prefix),
        "suffix": F.when(magic, "__").otherwise(suffix), "is_magic": magic,
    }


def case_style(core: Column) -> Column:
    has = core.rlike
    upper, lower = has(r"\p{Lu}") & ~has(r"\p{Ll}"), has(r"\p{Ll}") & ~has(r"\p{Lu}")
    title = ~has(r"(?<!\p{L})\p{Ll}") & ~has(r"(?<=\p{L})\p{Lu}") & has(r"\p{Lu}")
    return (
        F.when(core == "", "unknown").when(core.contains("."), "dot.case")
        .when(core.contains("-"), F.when(upper, "COBOL-CASE").when(title | has(r"^\p{Lu}.*\p{Lu}"), "Train-Case").otherwise("kebab-case"))
        .when(core.contains("_"), F.when(upper, "SCREAMING_SNAKE_CASE").otherwise("snake_case"))
        .when(has(r"^\p{Ll}") & has(r"\p{Lu}"), "camelCase").when(has(r"^\p{Lu}") & has(r"\p{Ll}"), "PascalCase")
        .when(upper, "UPPERFLATCASE").when(lower, "flatcase").otherwise("unknown")
    )


def words(core: Column) -> Column:
    """Lower-case words, split at acronym and camel borders, '_' and '-'."""
    cut = F.regexp_replace(F.regexp_replace(F.translate(core, "-", "_"), "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.transform(F.filter(F.split(cut, "_"), lambda w: w != ""), F.lower)


def grammar(tokens: Column) -> dict[str, Column]:
    """verb, entity and qualifier."""
    first = F.get(tokens, F.lit(0))
    verb = F.when(_among(first, VERBS), first)
    rest = F.slice(tokens, F.when(verb.isNotNull(), 2).otherwise(1), F.greatest(F.size(tokens), F.lit(1)))
    # the leading stop words are those before the first word that isn't one
    keep = F.array_position(F.transform(rest, lambda w: ~_among(w, STOP_WORDS)), F.lit(True))
    kept = F.when(keep > 0, F.slice(rest, keep.cast("int"), F.greatest(F.size(rest), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    qualifier = F.array_join(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), "_")
    return {"verb": verb, "entity": F.get(kept, F.lit(0)), "qualifier": F.when(qualifier != "", qualifier)}


def canonical_verb(tokens: Column) -> Column:
    table = {w: k for k, ws in SYNONYMS.items() for w in ws.split()}
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, F.get(F.filter(tokens, lambda w: _among(w, table)), F.lit(0))), F.lit("unknown"))


def canonical_entity(tokens: Column) -> Column:
    verbs = [w for ws in SYNONYMS.values() for w in ws.split()]
    plain = F.filter(tokens, lambda w: ~_among(w, [*verbs, *STOP_WORDS, *NOISY]))
    word = F.coalesce(F.get(plain, F.lit(0)), F.get(F.filter(tokens, lambda w: ~_among(w, verbs)), F.lit(0)))
    single = F.when(word.endswith("s") & (F.length(word) > 3) & ~word.endswith("ss"), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    out = F.regexp_replace(single, f"({ENTITY_ENDS})$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "unknown").otherwise(out)


def domain(path: Column) -> Column:
    p = F.lower(path)
    out = F.when(path == "", "unknown")
    for name, pattern in DOMAINS:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("core")


def intent(verb: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in INTENTS.items() for x in kv)), verb), F.lit("operation"))


def analyse(names: DataFrame, raw: str = "raw", path: str | None = None) -> DataFrame:
    """names with the analysis of column raw; an empty or null name is unknown in all."""
    a = affixes(F.coalesce(F.col(raw), F.lit("")))
    df = names.select("*", *(c.alias(k) for k, c in a.items()))
    df = df.withColumn("case_style", case_style(F.col("core"))).withColumn("tokens", words(F.col("core")))
    g = grammar(F.col("tokens"))
    df = df.select("*", *(c.alias(k) for k, c in g.items()), canonical_verb(F.col("tokens")).alias("canonical_verb"), canonical_entity(F.col("tokens")).alias("canonical_entity"), (domain(F.col(path)) if path else F.lit("unknown")).alias("domain"))
    return df.withColumn("intent", F.when(F.coalesce(F.col(raw), F.lit("")) == "", "unknown").otherwise(intent(F.col("canonical_verb"))))
