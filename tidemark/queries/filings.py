"""Queries from filings to events over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import markup
from tidemark.functions import text_keys as K
from tidemark.operators import entities, filings
from tidemark.queries.study import PARTY, STOPS
from tidemark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# What the classifier of these queries asks for; all of it is a parameter.
RULES = filings.Rules(
    strong={"merger_agreement": "merger agreement", "plan_of_merger": "plan of merger", "tender": "tender(?:ed)?", "acquired_by": "to be acquired by", "definitive": "definitive agreement"},
    supporting={"letter": "unsolicited letter", "combination": "combination", "antitrust": "antitrust clearance"},
    excluding={"owner": "sole beneficial owner", "record": "record date"},
    forms={"8-K": 1, "SC TO-T": 2}, items=("1.01", "2.01", "8.01"), item_form="8-K", sure_forms=("SC TO-T",), side_forms=("14D9",), side_labels=("acquired_by",),
    kinds=(("tender_offer", ("SC TO-T",), ("tender",)), ("merger", ("425", "S-4"), ())),
)
FORMS = {"filing_8k": "8-K", "filing_tender": "SC TO-T"}
PLACES = ("NYSE", "Nasdaq")
MENTIONS = (r"(?i)calls on {}\b", r"(?i)\({}\)", r"(?i)options on {}\b")
CONTEXT = (r"([A-Z][\w.& ]+?) said on", r"board of ([A-Z][\w.& ]+?) received", r"acquired by ([A-Z][\w.& ]+?) for")
LEADING = ("will acquire|to acquire|acquire|acquired", "announced|delivered|made")
TRAILING = "common stock|shares|stock"
WORDS = ", ".join(f"'{w}'" for w in K.SLUG_WORDS)


def _slug(c: str) -> str:
    return f"nullif(array_to_string(list_slice(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({WORDS})), 1, 8), '_'), '')"


def _sym(c: str) -> str:
    return f"translate(upper(trim({c})), '/-', '..')"


def _cik(c: str) -> str:
    d = f"ltrim(regexp_replace(CAST({c} AS VARCHAR), '\\D', '', 'g'), '0')"
    return f"CASE WHEN length({d}) > 10 THEN {d} WHEN {d} <> '' THEN lpad({d}, 10, '0') END"


def _clean(x: str) -> str:
    stop = "(?i)\\b(?:" + "|".join(STOPS) + ")\\b"
    cut = f"CASE WHEN regexp_matches({x}, '{stop}') THEN regexp_extract({x}, '(?is)^(.*?)\\b(?:{'|'.join(STOPS)})\\b', 1) ELSE {x} END"
    text = f"trim(regexp_replace({cut}, '\\s+', ' ', 'g'), ' ,.;:-')"
    return f"CASE WHEN {text} <> '' AND len(string_split({text}, ' ')) <= 12 THEN {text} END"


def _hits(labels: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\\b(?:{p})\\b') THEN '{n}' END" for n, p in labels.items()) + "], lambda x: x IS NOT NULL)"


_CLASSED = f"""h AS (SELECT *, CASE source WHEN 'filing_8k' THEN '8-K' WHEN 'filing_tender' THEN 'SC TO-T' ELSE '' END AS form, CASE WHEN source = 'filing_8k' AND underlying_symbol IS NOT NULL THEN '8.01' ELSE '' END AS items,
        {_hits(RULES.strong)} AS strong, {_hits(RULES.supporting)} AS supporting, {_hits(RULES.excluding)} AS excluding FROM documents),
    classed AS (SELECT *, CAST(2 * len(strong) + len(supporting) - 3 * len(excluding) + CASE form WHEN '8-K' THEN 1 WHEN 'SC TO-T' THEN 2 ELSE 0 END
        + CASE WHEN starts_with(form, '8-K') AND items = '8.01' THEN 1 ELSE 0 END AS BIGINT) AS score FROM h),
    judged AS (SELECT *, score >= 3 AND (len(strong) > 0 OR form = 'SC TO-T') AS is_candidate, form = 'SC TO-T' OR list_contains(strong, 'acquired_by') AS is_side,
        CASE WHEN form = 'SC TO-T' OR list_contains(strong, 'tender') THEN 'tender_offer' WHEN len(strong) > 0 THEN 'merger' ELSE 'other' END AS kind FROM classed)"""


def _classified(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text", "source", "underlying_symbol", *columns)
    form = F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])[F.col("source")]
    items = F.when((F.col("source") == "filing_8k") & F.col("underlying_symbol").isNotNull(), "8.01")
    return t.withColumns(filings.classify("text", form, items, RULES))


@query(f"WITH {_CLASSED} SELECT doc_id, array_to_string(list_concat(strong, supporting), ';') AS labels, array_to_string(excluding, ';') AS excluded, score, is_candidate, is_side, kind FROM judged")
def filing_classify(spark: SparkSession, d: str) -> DataFrame:
    """Every document's labels, score, whether it tells of a deal and of which side, and the kind of deal."""
    return _classified(spark, d).select("doc_id", F.concat_ws(";", "strong", "supporting").alias("labels"), F.array_join("excluding", ";").alias("excluded"), "score", "is_candidate", "is_side", "kind")


@query("SELECT DISTINCT regexp_replace(upper(trim(replace(source, '_', ' ') || CASE WHEN lang <> 'en' THEN '/a ' ELSE '' END)), '/A$', '') AS form FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def form_base(spark: SparkSession, d: str) -> DataFrame:
    """Forms with and without the mark of an amendment as one."""
    t = table(spark, d, "documents", "source", "lang")
    return filings.base_forms(t.select(F.concat(F.replace("source", F.lit("_"), F.lit(" ")), F.when(F.col("lang") != "en", "/a ").otherwise(F.when(F.col("lang").isNotNull(), ""))).alias("f")), "f")


@query("""WITH s AS (SELECT DISTINCT translate(upper(trim(ticker)), '/-', '..') AS symbol FROM deal_party WHERE ticker IS NOT NULL),
    q AS (SELECT symbol, CASE WHEN length(symbol) <= 4 THEN ['"symbol ' || symbol || '"', '"NYSE: ' || symbol || '"', '"Nasdaq: ' || symbol || '"', symbol]
        ELSE [symbol, '"symbol ' || symbol || '"', '"NYSE: ' || symbol || '"', '"Nasdaq: ' || symbol || '"'] END AS l FROM s)
    SELECT symbol, CAST(i AS BIGINT) AS step, l[i] AS query FROM q, unnest(generate_series(1, len(l))) t(i)""")
def symbol_searches(spark: SparkSession, d: str) -> DataFrame:
    """The searches for each ticker in their order."""
    s = table(spark, d, "deal_party", "ticker").where("ticker is not null").select(K.symbol("ticker").alias("symbol")).distinct()
    return s.select("symbol", F.explode(filings.search_queries("symbol", PLACES)).alias("q")).select("symbol", F.col("q.step").cast("bigint").alias("step"), "q.query")


@query("""SELECT doc_id, 'https://host/data/' || ltrim(lpad(CAST(doc_id AS VARCHAR), 10, '0'), '0') || '/' || replace(accession_number, '-', '') || '/' || accession_number || '.txt' AS url FROM documents""")
def filing_urls(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's filing lies."""
    t = table(spark, d, "documents", "doc_id", "accession_number")
    return t.select("doc_id", filings.filing_url("https://host/data/", F.lpad(F.col("doc_id").cast("string"), 10, "0"), "accession_number").alias("url"))


@query("SELECT doc_id, coalesce(" + " OR ".join(f"regexp_matches(text, '{p.split('{}')[0]}' || regexp_escape(underlying_symbol) || '{p.split('{}')[1]}')" for p in MENTIONS) + ", false) AS mentioned FROM documents")
def symbol_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document names its symbol as one that trades."""
    t = table(spark, d, "documents", "doc_id", "text", "underlying_symbol")
    return t.select("doc_id", filings.mentions_symbol("text", "underlying_symbol", MENTIONS).alias("mentioned"))


_LEAD = "x"
for _p in LEADING:
    _LEAD = f"regexp_replace({_LEAD}, '(?i)^.*?\\b(?:{_p})\\b\\s+', '')"
_EVERY = " || ".join(f"regexp_extract_all(coalesce(text, ''), '{p}', 1)" for p in CONTEXT)


@query(f"""WITH a AS (SELECT doc_id, list_transform({_EVERY}, lambda x: {_clean('x')}) AS l FROM documents),
    b AS (SELECT doc_id, list_transform(l, lambda x: nullif(trim(regexp_replace(regexp_replace({_LEAD}, '(?i)\\b(?:{TRAILING})\\b\\s*$', ''), '\\s+', ' ', 'g'), ' ,.;:-'), '')) AS l FROM a)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x IS NOT NULL))), ';') AS names FROM b""")
def context_names(spark: SparkSession, d: str) -> DataFrame:
    """The companies each document names where a symbol's company would stand."""
    t = table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.array_join(filings.context_names("text", CONTEXT, STOPS, LEADING, TRAILING), ";").alias("names"))


_DISPLAY = r"([^();|]+?)\s*(?:\(([A-Z][A-Z0-9.\-, ]*)\)\s*)?\(CIK\s+(\d{1,10})\)"


@query(f"""WITH m AS (SELECT match_id, {_sym('underlying_symbol')} AS s, match_source = 'display_names' AS hints, matched_company_name || coalesce(' (' || trim(matched_ticker) || ')', '') || ' (CIK ' || lpad(CAST(cik AS VARCHAR), 10, '0') || ')' AS t FROM matched_company WHERE cik IS NOT NULL),
    p AS (SELECT match_id, s, hints, trim(regexp_extract(t, '{_DISPLAY}', 1)) AS name, nullif(regexp_extract(t, '{_DISPLAY}', 2), '') AS ticker, lpad(regexp_extract(t, '{_DISPLAY}', 3), 10, '0') AS cik FROM m WHERE regexp_matches(t, '{_DISPLAY}')),
    q AS (SELECT *, coalesce(list_contains(list_transform(string_split(ticker, ','), lambda x: {_sym('x')}), s), false) AS by_ticker,
        coalesce(len(list_filter(string_split({_slug('name')}, '_'), lambda w: starts_with(w, lower(s)))) > 0, false) AS by_hint FROM p)
    SELECT match_id, nullif(name, '') AS name, cik, CASE WHEN by_ticker THEN 'display_ticker' WHEN hints AND by_hint THEN 'display_hint' ELSE 'display_single' END AS source,
        CAST(CASE WHEN by_ticker THEN 95 WHEN hints AND by_hint THEN 94 ELSE 93 END AS BIGINT) AS score FROM q""")
def display_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Whom display names with tickers and numbers speak for, and how surely."""
    m = table(spark, d, "matched_company").where("cik is not null")
    text = F.concat("matched_company_name", F.coalesce(F.concat(F.lit(" ("), F.trim("matched_ticker"), F.lit(")")), F.lit("")), F.lit(" (CIK "), F.lpad(F.col("cik").cast("string"), 10, "0"), F.lit(")"))
    got = m.select("match_id", F.explode(filings.display_candidates(text, "underlying_symbol", hints=F.coalesce(F.col("match_source") == "display_names", F.lit(False)), single=F.lit(True))).alias("c"))
    return got.select("match_id", "c.name", "c.cik", "c.source", F.col("c.score").cast("bigint").alias("score"))


_LOOKED = f"""c AS (SELECT DISTINCT {_cik('cik')} AS cik, name, {_sym('ticker')} AS t, {_slug('name')} AS k FROM company_lookup),
    bc AS (SELECT cik, min(name) AS name FROM c WHERE cik IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) = 1 AND count(*) = count(name)),
    bt AS (SELECT t, min(name) AS name FROM c WHERE t IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) = 1 AND count(*) = count(name)),
    bk AS (SELECT k, min(name) AS name FROM c WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) = 1)"""


@query(f"""WITH {_LOOKED}, p AS (SELECT party_id, name AS given, {_cik('cik')} AS cik, {_sym('ticker')} AS t, {_slug('name')} AS k FROM deal_party)
    SELECT party_id, coalesce(CASE WHEN p.cik IS NOT NULL THEN bc.name WHEN p.t IS NOT NULL THEN bt.name WHEN p.k IS NOT NULL THEN bk.name END, given) AS identity FROM p LEFT JOIN bc USING (cik) LEFT JOIN bt ON bt.t = p.t LEFT JOIN bk ON bk.k = p.k""")
def party_identity(spark: SparkSession, d: str) -> DataFrame:
    """The listed name of each party by its number, else its ticker, else its name; the given name where that finds none."""
    c = table(spark, d, "company_lookup", "cik", "name", "ticker").select(K.cik10("cik").alias("cik"), "name", K.symbol("ticker").alias("t"), K.slug("name").alias("k"))
    p = table(spark, d, "deal_party", "party_id", "cik", "ticker", "name").select("party_id", F.col("name").alias("given"), K.cik10("cik").alias("cik"), K.symbol("ticker").alias("t"), K.slug("name").alias("k"))
    got = entities.identify(p, [(k, entities.unique_lookup(c, k, ["name"]), "name") for k in ("cik", "t", "k")], "found")
    return got.select("party_id", F.coalesce("found", "given").alias("identity"))


_STRUCT = f"{{'cik': {_cik('cik')}, 'name': name, 'ticker': ticker, 'firm_id': firm_id, 'told_by': resolution}}"
_WANTED = {"subject": "resolution = 'subject_company' AND party_role <> 'acquirer'", "filer": "resolution = 'filer' AND party_role <> 'acquirer'", "text_target": "resolution = 'text' AND party_role <> 'acquirer'",
           "matched": "resolution = 'matched_option_symbol'", "filed_by": "resolution = 'filed_by'", "text_acquirer": "resolution = 'text' AND party_role = 'acquirer'"}
_FIRST = f"""f AS (SELECT event_id, {', '.join(f"arg_min({_STRUCT}, party_id) FILTER (WHERE {c}) AS {n}" for n, c in _WANTED.items())} FROM deal_party WHERE event_id IS NOT NULL GROUP BY 1)"""


def _same(a: str, b: str) -> str:
    x, y = _slug(f"{a}.name"), _slug(f"{b}.name")
    return f"coalesce(CASE WHEN {a}.cik IS NOT NULL AND {b}.cik IS NOT NULL THEN {a}.cik = {b}.cik WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} = {y} ELSE {_sym(f'{a}.ticker')} = {_sym(f'{b}.ticker')} END, false)"


def _roles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "deal_party").where("event_id is not null")
    return filings.first_of(p, ["event_id"], {n: F.expr(c) for n, c in _WANTED.items()}, {"cik": K.cik10("cik"), "name": "name", "ticker": "ticker", "firm_id": "firm_id", "told_by": "resolution"}, ["party_id"])


@query(f"""WITH {_FIRST}, t AS (SELECT *, coalesce(subject, filer, text_target, matched) AS target FROM f),
    a AS (SELECT *, coalesce(CASE WHEN NOT {_same('filed_by', 'target')} THEN filed_by END, CASE WHEN NOT {_same('filer', 'target')} THEN filer END, CASE WHEN NOT {_same('text_acquirer', 'target')} THEN text_acquirer END) AS acquirer FROM t)
    SELECT event_id, target.name AS target_name, target.told_by AS target_by, acquirer.name AS acquirer_name, acquirer.told_by AS acquirer_by,
        CASE WHEN target.firm_id IS NOT NULL THEN target.name WHEN target.name IS NOT NULL AND matched.firm_id IS NOT NULL THEN target.name ELSE matched.name END AS source_name,
        CASE WHEN target.firm_id IS NOT NULL THEN target.firm_id ELSE matched.firm_id END AS source_firm,
        CASE WHEN target.firm_id IS NOT NULL THEN target.told_by WHEN target.name IS NOT NULL AND matched.firm_id IS NOT NULL THEN target.told_by || '_matched' ELSE matched.told_by END AS source_by FROM a""")
def event_parties(spark: SparkSession, d: str) -> DataFrame:
    """Target, acquirer and source of each event by the best source that names them."""
    p = filings.deal_parties(_roles(spark, d), ["subject", "filer", "text_target"], ["filed_by", "filer", "text_acquirer"], "matched")
    return p.select("event_id", F.col("target.name").alias("target_name"), F.col("target.told_by").alias("target_by"), F.col("acquirer.name").alias("acquirer_name"), F.col("acquirer.told_by").alias("acquirer_by"),
                    F.col("source.name").alias("source_name"), F.col("source.firm_id").alias("source_firm"), F.col("source.told_by").alias("source_by"))


def _context(name: str) -> str:
    a, b = _slug(name), _slug("matched.name")
    return f"coalesce({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}), false)"


@query(f"""WITH {_FIRST}, e AS (
        SELECT event_id, subject AS p, 'subject' AS source, 100 AS score FROM f WHERE subject.cik IS NOT NULL AND {_context('subject.name')}
        UNION ALL SELECT event_id, filer, CASE WHEN {_context('filer.name')} THEN 'filer_context' ELSE 'filer_symbol' END, CASE WHEN {_context('filer.name')} THEN 90 ELSE 80 END FROM f
            WHERE filer.cik IS NOT NULL AND ({_context('filer.name')} OR (filer.name IS NOT NULL AND coalesce(filer.ticker = matched.ticker, false)))
        UNION ALL SELECT event_id, filed_by, 'filed_by_context', 85 FROM f WHERE filed_by.cik IS NOT NULL AND {_context('filed_by.name')})
    SELECT event_id, p.cik AS cik, p.name AS name, source, CAST(score AS BIGINT) AS score FROM e""")
def symbol_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Whom each event's filings speak for as the company behind its symbol."""
    r = _roles(spark, d)
    flat = {f"{role}_{f}": F.col(f"{role}.{f}") for role in ("subject", "filer", "filed_by") for f in ("cik", "name")}
    r = r.withColumns({**flat, "contexts": F.array_compact(F.array("matched.name")), "mentioned": F.coalesce(F.col("filer.ticker") == F.col("matched.ticker"), F.lit(False))})
    e = filings.evidence(r, ["event_id"], contexts="contexts", mentioned="mentioned")
    return e.withColumn("score", F.col("score").cast("bigint"))


_FITS = """list_filter(generate_series(1, len(cl)), lambda i: CASE WHEN n.party IS NOT NULL AND len(cl[i].parties) > 0
    THEN list_contains(cl[i].parties, n.party) AND n.day - cl[i].last <= 365 ELSE n.day - cl[i].last <= 30 END)"""
_NEW = "{'last': day, 'parties': CASE WHEN party IS NULL THEN CAST([] AS VARCHAR[]) ELSE [party] END}"
_SECOND = f"regexp_extract(text, '{PARTY[0]}', 2)"
_PAIR = f"CASE WHEN {_clean(f'''regexp_extract(text, '{PARTY[0]}', 1)''')} IS NOT NULL THEN {_clean(_SECOND)} END"


@query(f"""WITH RECURSIVE {_CLASSED}, kept AS (SELECT doc_id, underlying_symbol AS u, received_at, kind, CAST(received_at AS DATE) AS day, {_PAIR} AS name FROM judged WHERE is_candidate AND is_side AND underlying_symbol IS NOT NULL AND received_at IS NOT NULL),
    rows AS (SELECT *, {_slug('name')} AS party, row_number() OVER (PARTITION BY u ORDER BY received_at, doc_id) AS rn FROM kept),
    f AS (SELECT u, rn, doc_id, received_at, kind, name, day, party, CAST(1 AS BIGINT) AS hit, [{_NEW}] AS cl FROM rows WHERE rn = 1
        UNION ALL SELECT u, rn, doc_id, received_at, kind, name, day, party, hit, CASE WHEN hit > len(cl) THEN list_append(cl, {_NEW})
            ELSE list_transform(cl, lambda c, i: CASE WHEN i = hit THEN {{'last': greatest(c.last, day), 'parties': CASE WHEN party IS NULL OR list_contains(c.parties, party) THEN c.parties ELSE list_append(c.parties, party) END}} ELSE c END) END
        FROM (SELECT n.u, n.rn, n.doc_id, n.received_at, n.kind, n.name, n.day, n.party, cl, coalesce(list_max({_FITS}), len(cl) + 1) AS hit FROM f JOIN rows n ON n.u = f.u AND n.rn = f.rn + 1)),
    c AS (SELECT u, hit, min(rn) AS rn, min(received_at) AS first_at, max(received_at) AS last_at, count(*) AS n_filings, arg_min(kind, rn) AS kind, arg_min(doc_id, rn) AS doc_id,
        list_sort(list(DISTINCT name) FILTER (WHERE name IS NOT NULL)) AS names FROM f GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (ORDER BY u, rn) AS event_index, CASE WHEN len(names) = 1 THEN names[1] END AS counterparty, coalesce(len(names) > 1, false) AS is_conflicting FROM c)
    SELECT u || '_' || strftime(first_at, '%Y-%m-%d') || '_' || coalesce({_slug('counterparty')}, 'cluster' || lpad(CAST(event_index AS VARCHAR), 4, '0')) AS event_id, u AS underlying_symbol, first_at, last_at, n_filings, kind, doc_id, counterparty, is_conflicting, event_index FROM k""")
def filing_events(spark: SparkSession, d: str) -> DataFrame:
    """Documents that tell of a deal, folded into events with their one counterparty and an id."""
    t = _classified(spark, d, "received_at").where("is_candidate and is_side").withColumn("p", markup.parties("text", PARTY, STOPS))
    t = t.select("doc_id", "underlying_symbol", "received_at", "kind", F.col("p.second").alias("name")).withColumn("party", K.slug("name"))
    e = filings.event_rows(t, entity="underlying_symbol", at="received_at", tie="doc_id", party="party", name="name", carried=["kind", "doc_id"])
    return e.select("event_id", "underlying_symbol", "first_at", "last_at", "n_filings", "kind", "doc_id", "counterparty", "is_conflicting", "event_index")


@query(f"""WITH u AS (SELECT DISTINCT {_sym('underlying_symbol')} AS symbol FROM underlying_daily WHERE underlying_symbol IS NOT NULL AND quote_date BETWEEN DATE '2012-01-01' AND DATE '2016-12-31'),
    c AS (SELECT DISTINCT {_sym('ticker')} AS symbol, {_cik('cik')} AS cik, name FROM company_lookup WHERE ticker IS NOT NULL)
    SELECT symbol, cik, name, true AS matched FROM u JOIN c USING (symbol) UNION ALL SELECT symbol, NULL, NULL, false FROM u WHERE symbol NOT IN (SELECT symbol FROM c)""")
def symbol_companies(spark: SparkSession, d: str) -> DataFrame:
    """Symbols quoted in a span of days with the companies listed under them, and those without any."""
    u = table(spark, d, "underlying_daily", "underlying_symbol", "quote_date")
    c = table(spark, d, "company_lookup", "ticker", "cik", "name").select(K.symbol("ticker").alias("symbol"), K.cik10("cik").alias("cik"), "name").where("symbol is not null").distinct()
    s = entities.symbol_universe(u, "underlying_symbol", "quote_date", "2012-01-01", "2016-12-31")
    return entities.matched_and_not(s, c, "symbol")


@query(f"""WITH {_CLASSED}, x AS (SELECT judged.*, CASE WHEN {_PAIR} IS NOT NULL THEN {_clean(f"regexp_extract(text, '{PARTY[0]}', 1)")} END AS target, {_PAIR} AS acquirer FROM judged)
    SELECT doc_id, accession_number, form, score, is_candidate, is_side OR (target IS NOT NULL AND acquirer IS NOT NULL) AS is_side, kind, target, acquirer, {_slug('acquirer')} AS acquirer_slug,
        CASE WHEN len(strong) + len(supporting) > 0 THEN true ELSE false END AS has_labels, underlying_symbol FROM x""")
def filing_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their class, parties and keys in one wide row; parties told on both sides tell the side too."""
    t = _classified(spark, d, "accession_number").withColumn("p", markup.parties("text", PARTY, STOPS))
    form = F.coalesce(F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])[F.col("source")], F.lit(""))
    return t.select(
        "doc_id", "accession_number", form.alias("form"), "score", "is_candidate", (F.col("is_side") | F.col("p").isNotNull()).alias("is_side"), "kind", F.col("p.first").alias("target"), F.col("p.second").alias("acquirer"),
        K.slug("p.second").alias("acquirer_slug"), (F.size("strong") + F.size("supporting") > 0).alias("has_labels"), "underlying_symbol",
    )


@query("""SELECT DISTINCT a.event_id, a.event_trading_date AS day FROM event_alignment a JOIN (SELECT DISTINCT filing_date AS day FROM deal_party WHERE filing_date IS NOT NULL) f ON a.event_trading_date = f.day OR CAST(a.received_at AS DATE) = f.day""")
def disclosed_on(spark: SparkSession, d: str) -> DataFrame:
    """Events that trade or were received on a day of a filing: either date may meet."""
    e = table(spark, d, "event_alignment", "event_id", "event_trading_date", "received_at")
    days = table(spark, d, "deal_party", "filing_date").where("filing_date is not null").distinct()
    # Either date as a row of its own, so that the join is an equi-join.
    either = e.select("event_id", F.col("event_trading_date").alias("day"), F.explode(F.array_distinct(F.array("event_trading_date", F.to_date("received_at")))).alias("filing_date"))
    return either.join(days, "filing_date", "left_semi").select("event_id", "day").distinct()
