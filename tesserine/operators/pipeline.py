"""What happens around a search: rules, redirects, synonyms, boosts, promotions, merges and paging."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SYNONYM_QUERIES = 10
MAX_INDICES = 5
SAFE_SCHEMES = ("http", "https")


def _patterns(value: str) -> list[str]:
    return [p.strip().lower() for p in value.split(",") if p.strip()]


def matches(query: str, match_type: str, value: str) -> bool:
    """P1 for one rule: exact, contains, prefix over comma-separated patterns; regex without case, pattern up to 500 and subject up to 256 characters."""
    q = query.strip().lower()
    if match_type == "regex":
        if len(value) > 500:
            return False
        try:
            return re.search(value, q[:256], re.I) is not None
        except re.error:
            return False
    test = {"exact": q.__eq__, "contains": q.__contains__, "prefix": q.startswith}.get(match_type)
    return test is not None and any(test(p) for p in _patterns(value))


def match_rules(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """P1 for many queries at once: ``rules(rule_id, match_type, pattern, priority, ...)``, one row a pattern; the rule list is configuration and small."""
    q = F.lower(F.trim(F.col("query")))
    p = F.lower(F.trim(F.col("pattern")))
    hit = F.when(F.col("match_type") == "exact", q == p).when(F.col("match_type") == "contains", q.contains(p)).when(F.col("match_type") == "prefix", q.startswith(p)).otherwise(F.substring(q, 1, 256).rlike(F.concat(F.lit("(?i)"), F.col("pattern"))))
    return queries.join(F.broadcast(rules), hit).select("query", "rule_id", "priority").distinct()


def applicable(rules: DataFrame, index_handle: str, site_id: int) -> DataFrame:
    """Enabled rules of an index and site; null means all."""
    return rules.where("enabled").where(F.col("index_handle").isNull() | (F.col("index_handle") == index_handle)).where(F.col("site_id").isNull() | (F.col("site_id") == site_id)).orderBy(F.desc("priority"), "rule_id")


def redirect(query: str, rules: list[dict]) -> str | None:
    """The target of the first matching redirect rule by priority; only web addresses and paths."""
    for rule in sorted(rules, key=lambda r: (-r.get("priority", 0), r["rule_id"])):
        if rule["action_type"] == "redirect" and matches(query, rule["match_type"], rule["match_value"]):
            url = (rule.get("action_value") or {}).get("url", "").strip()
            if url.startswith("/") and not url.startswith("//") or url.split(":", 1)[0].lower() in SAFE_SCHEMES and "://" in url:
                return url
    return None


def expand_synonyms(query: str, rules: list[dict]) -> list[str]:
    """The query and its synonyms, each once, ten at most."""
    found = [query]
    for rule in sorted(rules, key=lambda r: (-r.get("priority", 0), r["rule_id"])):
        if rule["action_type"] == "synonym" and matches(query, rule["match_type"], rule["match_value"]):
            found += (rule.get("action_value") or {}).get("terms", [])
    return list(dict.fromkeys(q.strip() for q in found if q.strip()))[:MAX_SYNONYM_QUERIES]


def union_max(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Hits of several queries, the best score of each."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(F.max("score").alias("score"))


def rule_boosts(hits: DataFrame, elements: dict[int, float] | None = None, sections: dict[str, float] | None = None, categories: list[tuple[int, float]] | None = None) -> DataFrame:
    """Element, section and category multipliers; of the categories the first that matches."""
    by = lambda column, factors: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in factors.items() for x in kv]), F.col(column)), F.lit(1.0)) if factors else F.lit(1.0)
    category: Column = F.lit(1.0)
    if categories:
        chain = None
        for c, f in categories:
            has = F.array_contains("category_ids", F.lit(c))
            chain = F.when(has, f) if chain is None else chain.when(has, f)
        category = F.coalesce(chain, F.lit(1.0))
    return hits.withColumn("score", F.round(F.col("score") * by("element_id", elements) * by("section_handle", sections) * category, 6))


def promote(hits: DataFrame, promoted: DataFrame) -> DataFrame:
    """``hits(element_id, score)`` of a page with ``promoted(element_id, position)`` at their places.

    Promoted elements leave their own rank; the others fill the free ranks in order of score. Promotions are
    applied only where there are hits; promoted rows have no score. Positions are distinct and within the page.
    """
    others = hits.join(F.broadcast(promoted.select("element_id")), "element_id", "left_anti")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "element_id"))  # a page
    taken = promoted.agg(F.array_sort(F.collect_set("position")).alias("taken"))
    ranked = others.withColumn("n", rank).join(F.broadcast(taken))
    # The n-th free rank: n and as many more as taken positions lie before it.
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("n"), lambda a, p: F.when(p <= a, a + 1).otherwise(a))
    out = ranked.select(free.alias("rank"), "element_id", "score", F.lit(False).alias("promoted"))
    some = hits.limit(1).select(F.lit(1).alias("_one"))
    placed = promoted.join(F.broadcast(some)).select(F.col("position").alias("rank"), "element_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("promoted"))
    return out.unionByName(placed)


def duplicate_promotions(promotions: DataFrame, new: DataFrame) -> DataFrame:
    """Promotions of the same element for the same query, case apart."""
    return promotions.withColumn("_q", F.lower("query")).join(new.select("element_id", F.lower("query").alias("_q")).distinct(), ["element_id", "_q"], "left_semi").drop("_q")


def multi_index(parts: dict[str, DataFrame], limit: int, offset: int = 0) -> DataFrame:
    """P5: each index's best, tagged, merged by score as it is; promoted rows without score come last."""
    tagged = [df.orderBy(F.desc("score"), "document_key").limit(limit + offset).withColumn("index_handle", F.lit(h)) for h, df in list(parts.items())[:MAX_INDICES]]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    out = out.orderBy(F.desc_nulls_last("score"), "index_handle", "document_key")
    return (out.offset(offset) if offset else out).limit(limit)


def requested_indices(requested: str | list[str], enabled: list[str]) -> list[str]:
    """M1: split, trimmed, each once, five at most, enabled ones."""
    names = requested.split(",") if isinstance(requested, str) else requested
    return [n for n in list(dict.fromkeys(x.strip() for x in names if x.strip()))[:MAX_INDICES] if n in enabled]


def type_filter(hits: DataFrame, types: list[str], exact_case: bool = True) -> DataFrame:
    return hits.where(F.col("type").isin(types)) if exact_case else hits.where(F.lower("type").isin([t.lower() for t in types]))


def present(hits: DataFrame, fields: list[str] | None = None, url_required: bool = False) -> DataFrame:
    """Without internal and bulky columns, unsafe addresses emptied, score last."""
    bulky = {"content", "body", "excerpt", "score"}
    keep = [c for c in hits.columns if not c.startswith("_") and c not in bulky and (fields is None or c in fields)]
    out = hits
    if "url" in hits.columns:
        out = out.withColumn("url", F.when(F.lower(F.trim("url")).rlike(r"^(https?://|/(?!/)|#)"), F.col("url")).otherwise(F.lit("")))
        out = out.where("url <> ''") if url_required else out
    return out.select(*keep, *(["score"] if "score" in hits.columns else []))


def retrievable_fields(index_list: list[str], request_list: list[str] | None = None) -> Callable[[str], bool]:
    """C14: ``*``, names, ``-name``; a request narrows what the index allows."""

    def allows(spec: list[str]) -> Callable[[str], bool]:
        out = {s[1:] for s in spec if s.startswith("-")}
        named = {s for s in spec if not s.startswith("-") and s != "*"}
        return lambda f: f not in out and ("*" in spec or f in named or not named and bool(out))

    own = allows(index_list)
    asked = allows(request_list) if request_list else lambda f: True
    return lambda f: own(f) and asked(f)


def limits(limit: int | None, autocomplete: bool = False) -> int:
    """20 of at most 200 hits, 10 of at most 100 suggestions."""
    default, most = (10, 100) if autocomplete else (20, 200)
    return min(most, limit if limit and limit > 0 else default)
