"""The engine's public side: which source rows an index takes, requests and their limits, hooks and transformers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import language_code, normalize_text
from tesserine.operators import index as I
from tesserine.operators import pipeline as P
from tesserine.operators import retrieval as R
from tesserine.operators import suggest as S
from tesserine.operators.metadata import tracking

#: The longest query, the most results a log row counts, the longest time a page may report.
MAX_QUERY, MAX_RESULTS, MAX_TOOK = 256, 1000, 60000
TRIGGERS = ("click", "enter", "idle", "unknown")


@dataclass(frozen=True)
class Source:
    """What an index takes: ``criteria`` is a function of the rows, or permitted values by column."""

    handle: str
    type: str | None = None
    site_ids: tuple[int, ...] | None = None
    enabled: bool = True
    criteria: Callable[[DataFrame], DataFrame] | dict[str, list] | None = None
    skip_without_url: bool = False

    def applies_to(self, site_id: int) -> bool:
        """M5: an index of no site applies to all."""
        return self.site_ids is None or site_id in self.site_ids


def source_rows(elements: DataFrame, of: Source) -> DataFrame:
    """Of ``elements`` the rows that an index takes: neither drafts nor revisions, of its type and sites, within its criteria; entries without address only if it takes them."""
    out = elements
    for flag in ("is_draft", "is_revision"):
        if flag in elements.columns:
            out = out.where(~F.coalesce(F.col(flag), F.lit(False)))
    if not of.enabled:
        return out.where("false")
    if of.type is not None:
        out = out.where(F.col("type") == of.type)
    if of.site_ids is not None:
        out = out.where(F.col("site_id").isin(list(of.site_ids)))
    if callable(of.criteria):
        out = of.criteria(out)
    for column, values in (of.criteria.items() if isinstance(of.criteria, dict) else ()):
        if values:
            out = out.where(F.col(column).isin(values))
    if of.skip_without_url and "url" in elements.columns:
        out = out.where((F.col("type") != "entry") | F.col("url").isNotNull())
    return out


Transformer = Callable[[DataFrame], DataFrame]


@dataclass
class Transformers:
    """What makes documents of elements, by element type; a type of its own overrides the automatic one."""

    automatic: Transformer
    own: dict[str, Transformer] = field(default_factory=dict)

    def register(self, kind: str, transform: Transformer) -> None:
        self.own[kind] = transform

    def apply(self, elements: DataFrame) -> DataFrame:
        """Documents of all elements; columns that only some transformers give are null elsewhere."""
        out = self.automatic(elements.where(~F.coalesce(F.col("type").isin(list(self.own)), F.lit(False))) if self.own else elements)
        for kind, transform in self.own.items():
            out = out.unionByName(transform(elements.where(F.col("type") == kind)), allowMissingColumns=True)
        return out


def automatic(elements: DataFrame) -> DataFrame:
    """Documents of ``elements(site_id, element_id, title, html, language, type, ...)``: headings' texts join the content, the excerpt is of the body."""
    from tesserine.functions import content

    found = elements.withColumn("headings", content.headings(F.col("html")))
    texts = F.array_join(F.transform("headings", lambda h: h["text"]), " ")
    body = content.clean_body(F.col("html"))
    key = F.concat_ws("_", F.col("element_id").cast("string"), F.col("site_id").cast("string"))
    return found.withColumns({"document_key": key, "content": content.join_parts(body, texts), "excerpt": content.excerpt(F.col("html"))}).drop("html")


def rebuild(elements: DataFrame, sources: list[Source], stop: list[str], transformers: Transformers | None = None) -> dict[str, I.Index]:
    """K9: an index of each enabled source, lazily: nothing is read before an index is used or written."""
    make = transformers.apply if transformers else lambda rows: rows
    return {of.handle: I.build(make(source_rows(elements, of)), stop) for of in sources if of.enabled}


def touched(indices: DataFrame, handle: str, now: Column, debounce: int = 60) -> DataFrame:
    """M3: ``indices(handle, last_indexed)`` with the time of an index that was not marked in the last ``debounce`` seconds."""
    old = F.col("last_indexed").isNull() | (F.col("last_indexed") < now - F.make_dt_interval(secs=F.lit(debounce))) if debounce > 0 else F.lit(True)
    return indices.withColumn("last_indexed", F.when((F.col("handle") == handle) & old, now).otherwise(F.col("last_indexed")))


class Refused(Exception):
    """A request that its key does not permit."""


@dataclass(frozen=True)
class Key:
    """The scope of an access key; None is no limit."""

    indices: tuple[str, ...] | None = None
    hosts: tuple[str, ...] | None = None
    most_hits: int | None = None
    enabled: bool = True

    def scope(self, requested: list[str], given: bool, enabled: list[str]) -> tuple[list[str], bool]:
        """The indices to ask, and whether they are a selection: an empty one then means none at all."""
        if not self.enabled:
            raise Refused("the key is disabled")
        if self.indices is None:
            return requested, given
        if not given:
            return [n for n in self.indices if n in enabled], True
        outside = [n for n in requested if n not in self.indices]
        if outside:
            raise Refused(f"not permitted: {', '.join(outside)}")
        return requested, True

    def limit(self, asked: int) -> int:
        return asked if self.most_hits is None else min(asked, self.most_hits)


def accepted(requests: DataFrame, per_minute: int) -> DataFrame:
    """Of ``requests(key, ts, id)`` those within the limit of their key's minute, in order of time and id."""
    minute = Window.partitionBy("key", "_minute").orderBy("ts", "id")
    ranked = requests.withColumn("_minute", F.date_trunc("minute", "ts")).withColumn("_r", F.row_number().over(minute))
    return ranked.where(F.col("_r") <= per_minute).drop("_minute", "_r")


def tracked_searches(requests: DataFrame, enabled: list[str]) -> DataFrame:
    """Log rows of ``requests(id, q, index_handles, results_count, trigger, source, cached, took)``, one for each index asked.

    Queries are cut, blank ones and those that name only unknown or more than five indices give none; counts
    and times are held in range; of a cached answer the time is 0, of an unknown one null.
    """
    split = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("index_handles", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    asked = requests.withColumn("_asked", split).withColumn("_known", F.array_intersect("_asked", F.array(*map(F.lit, enabled)).cast("array<string>")))
    good = asked.where(~F.trim("q").isin("", "0") & (F.size("_asked") <= P.MAX_INDICES) & ((F.size("_asked") == 0) | (F.size("_known") > 0)))
    took = F.col("took").try_cast("double")
    time = F.when(F.lower("cached").isin("1", "true", "yes", "on"), 0.0).when(F.lower("cached").isin("0", "false", "no", "off") & took.between(0, MAX_TOOK), took)
    handles = F.when(F.size("_asked") == 0, F.array(F.lit("all"))).otherwise(F.col("_known"))
    return good.select(
        "id", F.substring("q", 1, MAX_QUERY).alias("query"), F.explode(handles).alias("index_handle"), F.greatest(F.lit(0), F.least(F.lit(MAX_RESULTS), F.coalesce("results_count", F.lit(0)))).cast("int").alias("results_count"),
        F.when(F.col("trigger").isin(*TRIGGERS), F.col("trigger")).otherwise("unknown").alias("trigger"), F.coalesce(tracking(F.col("source"), 50, False), F.lit("frontend-widget")).alias("source"), time.alias("execution_time"),
        F.when(F.size("_known") > 1, F.concat(F.lit("r"), F.col("id").cast("string"))).alias("session_id"),
    )


def tracked_clicks(clicks: DataFrame, enabled: list[str]) -> DataFrame:
    """Of ``clicks(id, element_id, query, index_handle, position)`` those on an element; unknown indices are blank, positions out of range null."""
    element, place = F.col("element_id").try_cast("double").cast("long"), F.col("position").try_cast("double").cast("long")
    known = F.when(F.col("index_handle").isin(enabled), F.col("index_handle")).otherwise("")
    return clicks.where(element > 0).select("id", element.alias("element_id"), F.substring("query", 1, MAX_QUERY).alias("query"), known.alias("index_handle"), F.when(place.between(0, MAX_RESULTS), place).alias("position"))


_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ADDRESS = rf"^{_BYTE}(\.{_BYTE}){{3}}$|^[0-9a-f.]*:[0-9a-f:.]*$"
#: Addresses of no public network, as patterns of their text.
_LOCAL = r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|2[4-5]\d\.)|^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"


def located(rows: DataFrame, geo: DataFrame, default: dict[str, str]) -> DataFrame:
    """``rows(ip, ...)`` with ``geo(ip, country, city)``; what is no address, or one of no public network, gets the default place."""
    local = ~F.lower("ip").rlike(_ADDRESS) | F.lower("ip").rlike(_LOCAL)
    out = rows.join(geo.select("ip", *[F.col(c).alias(f"_{c}") for c in default]), "ip", "left")
    return out.select(*rows.columns, *[F.when(local, F.lit(v)).otherwise(F.col(f"_{c}")).alias(c) for c, v in default.items()])


def device(agent: Column) -> Column:
    """Device type, browser, system and robot of a user agent, by its own marks; a robot's other fields count too."""
    a = F.coalesce(agent, F.lit(""))
    robot = F.regexp_extract(a, r"(?i)([a-z]*(?:bot|crawler|spider|slurp))\b", 1)
    browser = F.when(a.rlike(r"Edg(e|A|iOS)?/"), "Edge").when(a.rlike(r"OPR/|Opera"), "Opera").when(a.rlike(r"Firefox/|FxiOS/"), "Firefox").when(a.rlike(r"Chrome/|CriOS/"), "Chrome").when(a.rlike(r"Version/.*Safari/"), "Safari")
    system = F.when(a.contains("Windows"), "Windows").when(a.rlike("iPhone|iPad|iPod"), "iOS").when(a.contains("Android"), "Android").when(a.contains("Mac OS X"), "macOS").when(a.contains("Linux"), "Linux")
    kind = F.when(a.rlike(r"iPad|Tablet") | (a.contains("Android") & ~a.contains("Mobile")), "tablet").when(a.rlike(r"Mobi|iPhone|iPod"), "mobile").when(a == "", F.lit(None)).otherwise("desktop")
    return F.struct(kind.alias("device_type"), browser.alias("browser"), system.alias("os_name"), (robot != "").alias("is_robot"), F.when(robot != "", robot).alias("bot_name"))


def is_balanced(expression: str) -> bool:
    """brackets in pairs outside quotes, and every quote closed."""
    depth, quote, i = 0, "", 0
    while i < len(expression):
        c = expression[i]
        if quote and c == "\\":
            i += 1
            if i == len(expression):
                return False
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return False
        i += 1
    return depth == 0 and not quote


def with_required(expression: str | None, required: str, operator: str = "AND") -> str:
    """a caller's expression that is whole joins the required one, any other is left out."""
    expression = (expression or "").strip()
    return f"({expression}) {operator} {required}" if expression and is_balanced(expression) else required


Hook = Callable[[DataFrame], DataFrame]


@dataclass
class Engine:
    """Several indices behind one search and one completion call, with the defaults of a public request.

    ``before`` hooks may rewrite the request or answer it, ``after`` hooks rewrite the hits.
    """

    indices: dict[str, I.Index]
    stop: list[str] = field(default_factory=list)
    settings: R.Settings = field(default_factory=R.Settings)
    before: list[Callable[[dict], dict | DataFrame | None]] = field(default_factory=list)
    after: list[Hook] = field(default_factory=list)

    def _asked(self, handles: str | list[str], key: Key | None) -> list[str]:
        enabled = list(self.indices)
        names = [n.strip() for n in (handles.split(",") if isinstance(handles, str) else handles) if n.strip()]
        if len(set(names)) > P.MAX_INDICES:
            return []
        chosen, given = P.requested_indices(names, enabled), bool(names)
        if key is not None:
            chosen, given = key.scope(chosen, given, enabled)
        return chosen if given else enabled

    def _empty(self) -> DataFrame:
        stats = next(iter(self.indices.values())).doc_stats
        return stats.where("false").select(F.lit("").alias("index_handle"), *I.KEY, F.lit(0.0).alias("score"))

    def search(self, query: str, handles: str | list[str] = "", limit: int | None = None, page: int = 0, site_ids: list[int] | None = None, language: str | None = None, types: str | list[str] | None = None, key: Key | None = None) -> DataFrame:
        """``index_handle, site_id, document_key, score`` of a page (from 0), best first; longer queries than permitted and unknown selections find nothing."""
        request = {"query": query, "handles": handles, "limit": limit, "page": page, "site_ids": site_ids, "language": language, "types": types}
        for hook in self.before:
            answer = hook(request)
            if isinstance(answer, DataFrame):
                return answer
            request = answer or request
        names = self._asked(request["handles"], key)
        size = P.limits(request["limit"])
        size = key.limit(size) if key else size
        if not request["query"].strip() or len(request["query"]) > MAX_QUERY or not names:
            return self._empty()
        kinds = [t.strip() for t in request["types"].split(",") if t.strip()] if isinstance(request["types"], str) else request["types"]
        parts = None
        for name in names:
            own = R.search_sites(self.indices[name], request["query"], request["site_ids"] or [1], request["language"], 0, 0, self.stop, self.settings, kinds)
            own = own.select(F.lit(name).alias("index_handle"), *I.KEY, "score")
            parts = own if parts is None else parts.unionByName(own)
        for hook in self.after:
            parts = hook(parts)
        offset = max(0, request["page"]) * size
        out = parts.orderBy(F.desc("score"), "index_handle", "document_key", "site_id")
        return (out.offset(offset) if offset else out).limit(size)

    def completions(self, query: str, handles: str | list[str] = "", limit: int | None = None, site_id: int = 1, key: Key | None = None) -> DataFrame:
        """``suggestion`` of all indices asked, each once, in order of index and rank."""
        return self._merged(query, handles, limit, key, lambda index, n: S.suggest(index, query, site_id, n), ["suggestion"])

    def results(self, query: str, handles: str | list[str] = "", limit: int | None = None, site_id: int | None = None, kind: str | None = None, key: Key | None = None) -> DataFrame:
        """``element_id, title, type`` of elements whose title begins with the query, each once, in order of index and title."""
        return self._merged(query, handles, limit, key, lambda index, n: S.elements(index.documents, query, site_id, kind, n), ["element_id", "title", "type"])

    def _merged(self, query: str, handles: str | list[str], limit: int | None, key: Key | None, ask: Callable[[I.Index, int], DataFrame], columns: list[str]) -> DataFrame:
        size = P.limits(limit, autocomplete=True)
        size = key.limit(size) if key else size
        names = self._asked(handles, key)
        ok = bool((normalize_text(query) or "").strip()) and len(query) <= MAX_QUERY and bool(names)
        out = None
        for place, name in enumerate(names if ok else list(self.indices)[:1]):
            own = ask(self.indices[name], size)
            # A list is as long as the limit, so its rank is taken in one small task.
            rank = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
            own = own.coalesce(1).select(*columns).withColumn("_rank", rank).withColumn("_place", F.lit(place))
            out = own if out is None else out.unionByName(own)
        out = out if ok else out.where("false")
        each = [c for c in ("element_id", "type") if c in columns] or columns
        first = Window.partitionBy(*each).orderBy("_place", "_rank")
        return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").orderBy("_place", "_rank").select(*columns)


def public_language(code: Column) -> Column:
    """U4: a request's language, or null where it is none."""
    return F.when(F.trim(code) != "", language_code(code))


def native_scores(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Q10: ``element_key, score`` of hits, the key made of element and site; of several sections the best counts."""
    found = hits.join(documents.select(*I.KEY, "element_id"), I.KEY)
    return found.groupBy(F.concat_ws("-", F.col("element_id").cast("string"), F.col("site_id").cast("string")).alias("element_key")).agg(F.max("score").alias("score"))


def native_search(index: I.Index, query: str, wanted: DataFrame, indices: DataFrame, fallback: Callable[[str], DataFrame], stop: list[str] | None = None, s: R.Settings = R.Settings()) -> DataFrame:
    """Q10: ``element_key, score`` from the index if it covers all of ``wanted(type, site_id)``, else what the native search ``fallback`` gives.

    ``wanted`` and ``indices`` are configuration: a row for each type and site.
    """
    from tesserine.operators.metadata import uncovered

    if not uncovered(wanted, indices).isEmpty():
        return fallback(query)
    sites = [r[0] for r in wanted.select("site_id").distinct().orderBy("site_id").collect()]
    return native_scores(R.search_sites(index, query, sites, limit=0, stop=stop, s=s), index.documents)


def usages(configurations: DataFrame, handle: Column | str) -> DataFrame:
    """Of ``configurations(kind, name, references)`` those that refer to a handle."""
    wanted = F.lit(handle) if isinstance(handle, str) else handle
    return configurations.where(F.array_contains("references", wanted)).select("kind", "name")
