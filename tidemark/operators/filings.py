"""Filings to events: classification, evidence of who a symbol was, parties of a deal, events of filings."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import markup
from tidemark.functions import text_keys as K
from tidemark.operators import clusters


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Rules(NamedTuple):
    """What makes a filing a candidate. Patterns are matched as whole words, in any case.

    ``strong``, ``supporting`` and ``excluding`` map labels to patterns and ``points`` says
    what a label of each counts; ``forms`` maps forms to points, ``items`` are item numbers
    of forms that begin with ``item_form`` and count one point together. ``sure_forms``
    make a candidate without a strong label and, like ``side_forms`` and ``side_labels``,
    tell the side; ``kinds`` are (name, forms, labels) in the order they are tried.
    """

    strong: dict[str, str]
    supporting: dict[str, str]
    excluding: dict[str, str]
    forms: dict[str, int]
    items: tuple[str, ...]
    item_form: str
    sure_forms: tuple[str, ...]
    side_forms: tuple[str, ...]
    side_labels: tuple[str, ...]
    kinds: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]
    other: str = "other"
    least: int = 3
    points: tuple[int, int, int] = (2, 1, -3)


def classify(text: Column | str, form: Column | str, items: Column | str, rules: Rules) -> dict[str, Column]:
    """``strong, supporting, excluding, score, is_candidate, is_side, kind`` of a filing; null texts, forms and items count as empty."""
    form, items = F.coalesce(_c(form), F.lit("")), F.coalesce(_c(items), F.lit(""))
    hits = {n: markup.label_hits(text, getattr(rules, n)) for n in ("strong", "supporting", "excluding")}
    counted = [F.size(h) * p for h, p in zip(hits.values(), rules.points, strict=True)]
    by_form = F.coalesce(F.create_map(*[F.lit(x) for kv in rules.forms.items() for x in kv])[form], F.lit(0))
    by_item = F.when(form.startswith(rules.item_form) & reduce(lambda a, b: a | b, [F.contains(items, F.lit(i)) for i in rules.items]), 1).otherwise(0)
    score = reduce(lambda a, b: a + b, [*counted, by_form, by_item])
    sure = form.isin(*rules.sure_forms)
    any_of = lambda labels: F.arrays_overlap(hits["strong"], F.array(*map(F.lit, labels)))
    kind: Column | None = None
    for name, forms, labels in rules.kinds:
        met = form.isin(*forms) | (any_of(labels) if labels else F.size(hits["strong"]) > 0)
        kind = F.when(met, name) if kind is None else kind.when(met, name)
    return {
        **hits, "score": score.cast("bigint"), "is_candidate": (score >= rules.least) & ((F.size(hits["strong"]) > 0) | sure),
        "is_side": sure | form.isin(*rules.side_forms) | any_of(rules.side_labels), "kind": kind.otherwise(rules.other),
    }


def base_form(form: Column | str) -> Column:
    """A form in upper case without its amendment mark; null for a blank."""
    return F.nullif(F.regexp_replace(F.upper(F.btrim(_c(form), F.lit(K.SPACE))), "/A$", ""), F.lit(""))


def base_forms(df: DataFrame, form: str) -> DataFrame:
    """``form``: the distinct forms without their amendments."""
    return df.select(base_form(form).alias("form")).where("form is not null").distinct()


def filing_url(root: str, cik: Column | str, accession: Column | str) -> Column:
    """Where a filing's text lies: number without zeros, accession without dashes, accession."""
    a = _c(accession)
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.regexp_replace(_c(cik), "^0+", ""), F.regexp_replace(a, "-", ""), F.concat(a, F.lit(".txt")))


def search_queries(symbol: Column | str, places: tuple[str, ...], short: int = 4) -> Column:
    """``array<struct<step, query>>`` to search a symbol by: in the order targeted, plain for a symbol of at most ``short`` letters, else plain first; repeats left out."""
    s = _c(symbol)
    targeted = [F.concat(F.lit('"symbol '), s, F.lit('"')), *(F.concat(F.lit(f'"{p}: '), s, F.lit('"')) for p in places)]
    queries = F.array_distinct(F.when(F.length(s) <= short, F.array(*targeted, s)).otherwise(F.array(s, *targeted)))
    return F.transform(queries, lambda q, i: F.struct((i + 1).alias("step"), q.alias("query")))


_META = r"([\\.\[\]{}()*+?^$|/-])"


def quoted(c: Column | str) -> Column:
    """A text as a pattern that matches it only."""
    return F.regexp_replace(_c(c), _META, r"\\$1")


def mentions_symbol(text: Column | str, symbol: Column | str, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern, with ``{}`` for the symbol, occurs in the text; false for nulls."""
    text, s = _c(text), quoted(symbol)
    found = [F.regexp(text, F.concat(*(x for i, part in enumerate(p.split("{}")) for x in ((s, F.lit(part)) if i else (F.lit(part),))))) for p in patterns]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def trimmed_context(c: Column | str, leading: tuple[str, ...], trailing: str) -> Column:
    """A captured name without what leads up to it (each pattern in turn) and words like share classes behind it; null if nothing is left."""
    out = _c(c)
    for p in leading:
        out = F.regexp_replace(out, rf"(?i)^.*?\b(?:{p})\b\s+", "")
    out = F.regexp_replace(F.regexp_replace(out, rf"(?i)\b(?:{trailing})\b\s*$", ""), r"[\s ]+", " ")
    return F.nullif(F.regexp_replace(out, r"^[ ,.;:-]+|[ ,.;:-]+$", ""), F.lit(""))


def context_names(text: Column | str, patterns: tuple[str, ...], stops: tuple[str, ...], leading: tuple[str, ...], trailing: str) -> Column:
    """The distinct names captured beside a symbol, cleaned, trimmed and sorted; an empty array for none."""
    every = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(p), F.lit(1)) for p in patterns)))
    clean = F.transform(every, lambda x: trimmed_context(markup.clean_capture(x, stops), leading, trailing))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull())))


def matches_context(name: Column | str, contexts: Column | str) -> Column:
    """Whether the slug of a name is, holds or is held by the slug of one of the names; false for nulls."""
    a = K.slug(name)
    near = lambda b: (a == b) | F.contains(a, b) | F.contains(b, a)
    return F.coalesce(F.exists(_c(contexts), lambda x: F.coalesce(near(K.slug(x)), F.lit(False))), F.lit(False))


def names_symbol(name: Column | str, symbol: Column | str) -> Column:
    """Whether a word of the name's slug begins with the symbol; false for nulls."""
    s = F.nullif(F.lower(K.symbol(symbol)), F.lit(""))
    return F.coalesce(F.exists(F.split(K.slug(name), "_"), lambda w: F.startswith(w, s)), F.lit(False))


def display_candidates(names: Column | str, symbol: Column | str, *, hints: Column, single: Column, scores: tuple[int, int, int] = (95, 94, 93)) -> Column:
    """``array<struct<name, cik, source, score>>`` of display names: those with the symbol as ticker, those
    that hint at it in their name (where ``hints``), and if there is neither the only name (where ``single``)."""
    parsed = markup.display_names(names)
    s = K.symbol(symbol)
    ticker = lambda x: F.coalesce(F.array_contains(F.transform(F.split(x["ticker"], ","), lambda t: K.symbol(t)), s), F.lit(False))
    hint = lambda x: hints & names_symbol(x["name"], s)
    as_ = lambda x, source, score: F.struct(x["name"].alias("name"), x["cik"].alias("cik"), F.lit(source).alias("source"), F.lit(score).alias("score"))
    told = F.transform(F.filter(parsed, lambda x: ticker(x) | hint(x)), lambda x: F.when(ticker(x), as_(x, "display_ticker", scores[0])).otherwise(as_(x, "display_hint", scores[1])))
    lone = F.transform(parsed, lambda x: as_(x, "display_single", scores[2]))
    none = F.slice(lone, 1, 0)
    return F.when(F.size(told) > 0, told).when(single & (F.size(parsed) == 1), lone).otherwise(none)


def page_candidates(html: Column | str, current: str, former: str, row: str, scores: tuple[int, int, int] = (95, 94, 92)) -> Column:
    """``array<struct<name, cik, source, score>>`` of a company search page: the current and the former names of a
    company's page (patterns that capture name and number), and the rows of a list (number, then name).
    Names come as the page spells them: take the page through ``plain_text`` of its entities first."""
    h = F.coalesce(_c(html), F.lit(""))

    def part(source: str, pattern: str, score: int, name: int, cik: int) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(h, F.lit(pattern), F.lit(name)).alias("name"), F.regexp_extract_all(h, F.lit(pattern), F.lit(cik)).alias("cik"))
        return F.transform(both, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.lpad(x["cik"], 10, "0").alias("cik"), F.lit(source).alias("source"), F.lit(score).alias("score")))

    return F.concat(part("page_current", current, scores[0], 1, 2), part("page_former", former, scores[1], 1, 2), part("page_row", row, scores[2], 2, 1))


def evidence(df: DataFrame, keep: list[str], *, contexts: str, mentioned: str, extra: list[str] = ()) -> DataFrame:
    """``keep, cik, name, source, score``: whom each hit speaks for, a row each.

    ``df`` has the header's roles (subject_cik, subject_name, filer_..., filed_by_...), the
    names near the symbol and whether the text names it as a trading symbol, and may have
    further candidates as arrays of (name, cik, source, score). A subject that fits the
    context counts 100, a filer 90 (without context but with the symbol 80), a filer on
    another's behalf 85.
    """
    fits = lambda role: F.col(f"{role}_cik").isNotNull() & matches_context(f"{role}_name", contexts)
    one = lambda role, source, score: F.struct(F.col(f"{role}_name").alias("name"), F.col(f"{role}_cik").alias("cik"), F.lit(source).alias("source"), F.lit(score).alias("score"))
    told = F.array_compact(F.array(
        F.when(fits("subject"), one("subject", "subject", 100)),
        F.when(fits("filer"), one("filer", "filer_context", 90)).when(F.col("filer_cik").isNotNull() & F.col("filer_name").isNotNull() & F.col(mentioned), one("filer", "filer_symbol", 80)),
        F.when(fits("filed_by"), one("filed_by", "filed_by_context", 85)),
    ))
    every = F.concat(told, *(F.coalesce(F.col(c), F.slice(told, 1, 0)) for c in extra))
    return df.select(*keep, F.explode(every).alias("e")).select(*keep, "e.cik", "e.name", "e.source", "e.score")


def same_party(a: Column | str, b: Column | str) -> Column:
    """Whether two party structs (cik, name, ticker) are one: by number if both have one, else by slug, else by ticker; never null."""
    a, b = _c(a), _c(b)
    x, y = K.slug(a["name"]), K.slug(b["name"])
    by = F.when(a["cik"].isNotNull() & b["cik"].isNotNull(), a["cik"] == b["cik"]).when(x.isNotNull() & y.isNotNull(), x == y)
    return F.coalesce(by.otherwise(K.symbol(a["ticker"]) == K.symbol(b["ticker"])), F.lit(False))


def deal_parties(df: DataFrame, targets: list[str], acquirers: list[str], matched: str) -> DataFrame:
    """``df`` with ``target``, ``acquirer`` and ``source`` structs (cik, name, ticker, firm_id, told_by).

    The columns named hold party structs or null, in the order they count. The target is the
    first there is, else the ``matched`` firm; the acquirer the first that isn't the target;
    the source is the target if it has a firm, else the target under the matched firm's
    symbols, else the matched firm.
    """
    target = F.coalesce(*(F.col(t) for t in targets), F.col(matched))
    out = df.withColumn("target", target)
    t, m = F.col("target"), F.col(matched)
    others = [F.when(~same_party(a, "target"), F.col(a)) for a in acquirers]
    as_matched = F.struct(F.coalesce(t["cik"], m["cik"]).alias("cik"), t["name"].alias("name"), m["ticker"].alias("ticker"), m["firm_id"].alias("firm_id"), F.concat(t["told_by"], F.lit("_matched")).alias("told_by"))
    source = F.when(t["firm_id"].isNotNull(), t).when(t["name"].isNotNull() & m["firm_id"].isNotNull(), as_matched).otherwise(m)
    return out.withColumns({"acquirer": F.coalesce(*others), "source": source})


def event_rows(df: DataFrame, *, entity: str, at: str, tie: str, party: str, name: str, carried: list[str], long_gap: int = 365, short_gap: int = 30, listed: bool = False) -> DataFrame:
    """One row per event: clusters of an entity's filings, each with what its first one carries.

    ``party`` is what filings of one event share (null: unknown). ``counterparty`` is the
    one distinct ``name`` of a cluster, null for none or several (``is_conflicting``);
    ``event_id`` is made of entity, day and the counterparty's slug or, without one, the
    cluster's number over all entities. Null entities and times are left out. ``listed``
    adds the ids of an event's ``filings`` as one text, which grows with the event.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    placed = clusters.assign_clusters(rows, entity, at, tie, party, long_gap, short_gap)
    order = F.struct(at, tie)
    ids = [F.array_join(F.array_sort(F.collect_set(F.col(tie).cast("string"))), ";").alias("filings")] if listed else []
    g = placed.groupBy(entity, "cluster").agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_filings"), F.min(name).alias("_least"), F.max(name).alias("_most"),
        *ids, *(F.min_by(c, order).alias(c) for c in carried), F.max("event_index").alias("event_index"),
    )
    several = F.coalesce(F.col("_least") != F.col("_most"), F.lit(False))
    g = g.withColumns({"counterparty": F.when(~several, F.col("_least")), "is_conflicting": several})
    key = F.coalesce(K.slug("counterparty"), F.concat(F.lit("cluster"), F.lpad(F.col("event_index").cast("string"), 4, "0")))
    return g.withColumn("event_id", F.concat_ws("_", F.col(entity).cast("string"), F.date_format("first_at", "yyyy-MM-dd"), key)).drop("_least", "_most", "cluster")


def first_of(df: DataFrame, keys: list[str], wanted: dict[str, Column], fields: dict[str, Column | str], order: list[str]) -> DataFrame:
    """Per key a struct of ``fields`` of the first row, in ``order``, that meets each condition."""
    at = F.struct(*order)
    s = F.struct(*(_c(c).alias(n) for n, c in fields.items()))
    return df.groupBy(*keys).agg(*(F.min_by(s, F.when(c, at)).alias(n) for n, c in wanted.items()))

