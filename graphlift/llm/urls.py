"""URL filters by association rules, in DataFrame functions only.

FP-growth mines combinations of URL tokens that go with a label in labelled URLs. Rules with enough support
and confidence, and no more general rule at least as confident, are kept. An inverted index from token to
rules finds those all of whose tokens a URL has; the most confident one decides. Hand-written base rules,
by host and path, come first.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, require_columns

ALLOW, BLOCK = "allow", "block"
#: Base rules: (verdict, host and path). A rule fits its host and all subdomains; the longest wins.
BASE = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))

#: Labelled URLs that rules are mined from at most: those with the least hash.
SAMPLE = 200_000
SUPPORT, CONFIDENCE, LONGEST, MOST_RULES = 0.005, 0.9, 3, 500
_MARK = "="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def base_rule(host: Column, path: Column, rules=BASE) -> tuple[Column, Column]:
    """The longest base rule that fits, and its verdict; null if none does."""
    found = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path with digits as 0, names of query parameters."""
    tagged = lambda tag, parts: F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(tag), x))
    segments = F.split(F.regexp_replace(path, r"\d+", "0"), "/")
    query = F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    return F.array_distinct(F.concat(tagged("host:", F.split(host, r"\.")), tagged("path:", segments), tagged("query:", query)))


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> list[Rule]:
    """labelled (tokens, verdict): rules, best first: by confidence, support, fewer tokens, then text.

    At most ``sample`` labelled rows are mined and MOST_RULES rules kept. Rows with null or no tokens, or a
    null label, teach nothing; without labelled rows there are no rules.
    """
    usable = labelled.where("verdict is not null and size(tokens) > 0")
    total = usable.count()
    if not total:
        return []
    if total > sample:
        usable = usable.where(F.pmod(F.xxhash64("tokens", F.monotonically_increasing_id()), F.lit(1 << 20)) < int(sample / total * (1 << 20)))
    items = usable.select(F.array_append("tokens", F.concat(F.lit(_MARK), "verdict")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    named = found.where(F.element_at("consequent", 1).startswith(_MARK) & (F.size("antecedent") <= LONGEST)).select(
        F.sort_array("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 100).alias("verdict"), "confidence", "support"
    )
    rows = named.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), F.array_join("tokens", " "), "verdict").limit(20 * MOST_RULES).collect()
    known = {(tuple(r.tokens), r.verdict): r.confidence for r in rows}

    def needed(r) -> bool:
        shorter = (c for n in range(1, len(r.tokens)) for c in combinations(r.tokens, n))
        return not any(known.get((c, r.verdict), 0) >= r.confidence for c in shorter)

    return [Rule(tuple(r.tokens), r.verdict, r.confidence, r.support) for r in rows if needed(r)][:MOST_RULES]


def best_rule(of: Column, rules: list[Rule]) -> Column:
    """Number (from 0) of the first rule all of whose tokens are in the array; null if none fits."""
    if not rules:
        return F.lit(None).cast("int")
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        for t in r.tokens:
            index.setdefault(t, []).append(k)
    posted = F.create_map(*[x for t, ks in sorted(index.items()) for x in (F.lit(t), F.lit(ks))])
    sizes = F.lit([len(r.tokens) for r in rules])
    met = F.flatten(F.filter(F.transform(of, lambda t: F.try_element_at(posted, t)), lambda x: x.isNotNull()))
    return F.array_min(F.filter(F.array_distinct(met), lambda k: F.size(F.filter(met, lambda m: m == k)) == F.get(sizes, k)))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=BASE, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, mined (tokens of the deciding mined rule), confidence.

    Rules are mined from ``labelled`` (url, verdict), by default from the pages that a base rule judges. A
    null url, or one without ``://``, has an empty host and path and no tokens. A url that neither a base
    rule nor a mined one fits is allowed. Ids may be null or repeated; an empty table gives an empty
    result. Other columns are not looked at.
    """
    require_columns(pages, id_col, url_col)

    def parsed(df: DataFrame, *kept: Column) -> DataFrame:
        split = df.select(*kept, F.col(url_col).alias("url")).withColumns(dict(zip(("host", "path"), host_and_path(F.col("url")), strict=True)))
        return split.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))

    rows = parsed(pages, F.col(id_col).alias("page_id"))
    rule, verdict = base_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "tokens", rule.alias("rule"), verdict.alias("base"))
    taught = rows.select("tokens", F.col("base").alias("verdict")) if labelled is None else parsed(labelled, F.col("verdict")).select("tokens", "verdict")
    mined = mine(taught)
    of_rule = lambda k, values: F.get(F.lit(values), k) if mined else F.lit(None)
    judged = rows.withColumn("k", F.when(F.col("base").isNull(), best_rule(F.col("tokens"), mined)))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("base", of_rule(F.col("k"), [r.verdict for r in mined]).cast("string"), F.lit(ALLOW)).alias("verdict"),
        of_rule(F.col("k"), [" ".join(r.tokens) for r in mined]).cast("string").alias("mined"),
        of_rule(F.col("k"), [r.confidence for r in mined]).cast("double").alias("confidence"),
    )
