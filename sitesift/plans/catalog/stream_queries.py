"""Streaming queries: each drains a stream over an input table and reads its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import DOM_FEATURES, HASH_DIM, MAX_TITLE_CODE_POINTS
from sitesift.functions.html import add_page_features
from sitesift.functions.urls import canonicalize_url
from sitesift.operators.metrics import temporal_cutoff
from sitesift.plans.catalog.html_queries import CANONICAL_SQL
from sitesift.plans.catalog.inputs import (
    WEIGHTS_SQL, canonical_sql, formula_weights, raw_from, rich_html, table,
)
from sitesift.plans.catalog.record_queries import _COUNTERS
from sitesift.plans.catalog.registry import query
from sitesift.plans.catalog.vector_queries import _SCORE, VECTOR_SQL
from sitesift.session import shared_folder
from sitesift.streaming import pages as S
from sitesift.streaming import tabs
from sitesift.streaming.positions import train_positions
from sitesift.streaming.train import StreamConfig, read_counts, train_stream

PAGE_SCHEMA = "page_id bigint, url string, html string"


def arrived(sf, name):
    """The path of a table as a stream's source: one file, or a folder of files (a pattern may be either)."""
    return f"{sf}/{{{name}.parquet}}"


def page_stream(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    return rich_html(S.stream_pages(spark, arrived(sf, "pages"), PAGE_SCHEMA, partitions=cores))


def record_stream(spark, sf):
    return S.stream_records(raw_from(page_stream(spark, sf)))


@query("stream_pages", f"WITH {CANONICAL_SQL} SELECT page_id, sample_id, title, label, parse_status FROM canonical")
def _(spark, sf):
    records = record_stream(spark, sf).select("page_id", "sample_id", "title", "label", "parse_status")
    return S.drain_to_table(records, shared_folder(spark, "offsets"), shared_folder(spark, "records"))


@query("stream_counts", f"WITH {_COUNTERS} SELECT kind, reason, n FROM counters")
def _(spark, sf):
    path = shared_folder(spark, "counts")
    S.drain_to_table(S.stream_counts(record_stream(spark, sf)), shared_folder(spark, "offsets"), path, "complete")
    return S.latest_batch(spark, path, "kind string, reason string, n bigint")


@query("score_stream", f"""WITH {_SCORE}, raw AS (SELECT page_id, CASE WHEN ends_with(url, '#top') OR contains(url, 'utm_source') THEN NULL WHEN starts_with(url, 'http:') THEN 1 ELSE 0 END AS label FROM rich),
{canonical_sql('pages', 'page_id', 'rc')} SELECT sha256(canonical) AS sample_id, label, 'ok' AS parse_status, round(1 / (1 + exp(-logit)), 6) AS score FROM lg JOIN raw USING (page_id) JOIN rc USING (page_id) WHERE label IS NOT NULL""")
def _(spark, sf):
    scored = S.score_stream(record_stream(spark, sf), formula_weights(spark), -0.25)
    out = S.drain_to_table(scored, shared_folder(spark, "offsets"), shared_folder(spark, "scores"))
    return out.withColumn("score", F.round("score", 6))


@query("stream_cutoff_filter", """WITH c AS (SELECT ts AS cutoff FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM events) WHERE r = ceil(0.90 * n))
SELECT event_id, event_type FROM events, c WHERE ts < cutoff""")
def _(spark, sf):
    schema = table(spark, sf, "events").schema
    cutoff = temporal_cutoff(table(spark, sf, "events")).first()["cutoff"]
    events = S.stream_pages(spark, arrived(sf, "events"), schema).withColumn("date", F.col("ts").cast("timestamp"))
    kept = S.stream_cutoff_filter(events, F.lit(cutoff), "before").select("event_id", "event_type")
    return S.drain_to_table(kept, shared_folder(spark, "offsets"), shared_folder(spark, "before"))


FOLDERS = 3  # where order matters, files arrive in so many folders, one after the other


def arriving(spark, frame, part, drained):
    """Write ``frame`` part by part and drain the stream after each; every drain is a restart."""
    folder, checkpoint, path = (shared_folder(spark, n) for n in ("arriving", "offsets", "out"))
    out = None
    for k in range(FOLDERS):
        frame.where(part == k).write.parquet(f"{folder}/{k}")
        out = drained(S.stream_pages(spark, f"{folder}/*", frame.schema), checkpoint, path)
    return out


@query("stream_dedupe", f"""WITH twice AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, url || '#again' FROM pages), {canonical_sql('twice', 'page_id')}
SELECT sha256(canonical) AS sample_id, arg_min(page_id, (page_id % 1000000000 % {FOLDERS}, page_id)) AS ord FROM canon GROUP BY canonical""")
def _(spark, sf):
    twice = F.array(
        F.struct("url", F.col("page_id").alias("ord")),
        F.struct(F.concat("url", F.lit("#again")).alias("url"), (F.col("page_id") + 1000000000).alias("ord")),
    )
    rows = table(spark, sf, "pages").select(F.explode(twice).alias("p")).select(
        F.sha2(canonicalize_url(F.col("p.url")), 256).alias("sample_id"), "p.ord"
    )
    return arriving(spark, rows, F.col("ord") % 1000000000 % FOLDERS, S.stream_dedupe)


# Live records: page title, three page features; some are refused.
_LIVE_SQL = f"""{VECTOR_SQL}, {WEIGHTS_SQL},
live AS (SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'url must use http or https' WHEN length(title) * CASE WHEN contains(url, '/es/') THEN 4097 ELSE 1 END > {MAX_TITLE_CODE_POINTS}
  THEN 'title exceeds supported length' END AS error FROM rich JOIN titles USING (page_id)),
allowed AS (SELECT page_id, idx, value FROM vec WHERE idx < {HASH_DIM} OR idx - {HASH_DIM} NOT IN (11, 12, 13, 14, 15, 16, 17, 18, 19) AND idx - {HASH_DIM} NOT BETWEEN 26 AND 38 OR idx - {HASH_DIM} IN (11, 12, 13)),
lv AS (SELECT page_id, sum(weight::DOUBLE * value::FLOAT::DOUBLE) + 0.1 AS logit FROM allowed JOIN weights USING (idx) GROUP BY page_id)"""


@query("live_scan_scores", f"""WITH {_LIVE_SQL} SELECT page_id, error, CASE WHEN error IS NULL THEN round(1 / (1 + exp(-logit)), 6) END AS probability,
  CASE WHEN error IS NOT NULL THEN 'unavailable' WHEN 1 / (1 + exp(-logit)) >= 0.5 THEN 'possible-phishing' ELSE 'no-signal' END AS status FROM live JOIN lv USING (page_id)""")
def _(spark, sf):
    names = DOM_FEATURES[:3]
    rows = add_page_features(page_stream(spark, sf))
    live = rows.select(
        "page_id", F.when(F.contains("url", F.lit("/de/")), F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url")).alias("url"),
        F.when(F.contains("url", F.lit("/es/")), F.repeat("title", F.lit(4097))).otherwise(F.col("title")).alias("title"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("dom"),
    )
    scored = S.live_scan_scores(live, formula_weights(spark), 0.1, 0.5)
    out = S.drain_to_table(scored, shared_folder(spark, "offsets"), shared_folder(spark, "live"))
    return out.select("page_id", "error", F.round("probability", 6).alias("probability"), "status")


# Tab events: purchases and views navigate, errors close, the rest are results for a page number.
_TABS = """ev AS (SELECT user_id AS tab, ts, event_id, CASE event_type WHEN 'error' THEN 'close' WHEN 'view' THEN 'navigate' WHEN 'purchase' THEN 'navigate' ELSE 'result' END AS kind,
  'u' || (floor(value)::BIGINT % 3) AS url FROM events),
marks AS (SELECT *, CASE WHEN kind = 'navigate' THEN url WHEN kind = 'close' THEN '' END AS mark FROM ev),
cur AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY tab ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current,
  max(CASE WHEN mark IS NOT NULL THEN ts END) OVER (PARTITION BY tab) AS moved FROM marks)"""


def tab_events(frame):
    kind = F.col("event_type")
    return frame.select(
        F.col("user_id").alias("tab"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(kind == "error", "close").when(kind.isin("view", "purchase"), "navigate").otherwise("result").alias("kind"),
        F.concat(F.lit("u"), F.pmod(F.floor("value"), F.lit(3))).alias("url"),
    )


@query("stale_result_filter", f"WITH {_TABS} SELECT tab, event_id, url, coalesce(current, '') <> url AS stale FROM cur WHERE kind = 'result'")
def _(spark, sf):
    return tabs.stale_results(tab_events(table(spark, sf, "events"))).select("tab", "event_id", "url", "stale")


@query("latest_state_per_key", f"""WITH {_TABS} SELECT tab, max(event_id) AS event_id, max_by(url, event_id) AS url FROM cur WHERE kind = 'result' AND current = url AND ts > moved GROUP BY tab""")
def _(spark, sf):
    return tabs.latest_state_per_key(tab_events(table(spark, sf, "events"))).select("tab", "event_id", "url")


def tab_stream(spark, sf, drained):
    """Tab events arrive in time order, a third of the time span in each folder."""
    events = tab_events(table(spark, sf, "events"))
    span = events.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
    step = (span["high"] - span["low"]) // FOLDERS + 1
    return arriving(spark, events, F.floor((F.unix_micros("ts") - span["low"]) / step), drained)


@query("stream_stale_results", f"WITH {_TABS} SELECT tab, event_id, url, coalesce(current, '') <> url AS stale FROM cur WHERE kind = 'result'")
def _(spark, sf):
    return tab_stream(spark, sf, tabs.stream_stale_results)


@query("stream_latest_state", f"""WITH {_TABS} SELECT tab, max(event_id) AS event_id, max_by(url, event_id) AS url FROM cur WHERE kind = 'result' AND current = url AND ts > moved GROUP BY tab""")
def _(spark, sf):
    return tab_stream(spark, sf, tabs.stream_latest_state).select("tab", "event_id", "url")


TRAINING = StreamConfig(source="pages")

def training_run(spark, sf):
    """Pages arrive folder by folder, by page number; the trainer stops and resumes between them."""
    folder, state = shared_folder(spark, "arriving"), shared_folder(spark, "training")
    pages, result = table(spark, sf, "pages").select("page_id", "url", "html"), None
    for k in range(FOLDERS):
        pages.where(F.pmod("page_id", F.lit(FOLDERS)) == k).write.parquet(f"{folder}/{k}")
        arrived = rich_html(S.stream_pages(spark, f"{folder}/*", PAGE_SCHEMA))
        result = train_stream(S.stream_records(raw_from(arrived)), state, TRAINING, resume=k > 0)
    return state, result


def _training_sql(config: StreamConfig) -> str:
    """The trainer's rule in SQL: a state table per pass of each batch."""
    steps = ["s0 AS (SELECT 0 AS idx, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS accum WHERE false)"]
    for k in range(FOLDERS):
        for _ in range(config.passes):
            i = len(steps)
            steps.append(f"""l{i} AS MATERIALIZED (SELECT page_id, label, sum(coalesce(weight, 0) * value) AS logit FROM x LEFT JOIN s{i - 1} USING (idx) WHERE page_id % {FOLDERS} = {k} GROUP BY page_id, label),
g{i} AS MATERIALIZED (SELECT idx, sum(value * (1 / (1 + exp(-logit)) - l{i}.label)) / (SELECT count(*) FROM l{i}) AS g FROM x JOIN l{i} USING (page_id) GROUP BY idx),
d{i} AS (SELECT coalesce(s.idx, g.idx) AS idx, coalesce(weight, 0) AS weight, coalesce(accum, 0) AS accum, coalesce(g, 0) + CASE WHEN coalesce(s.idx, g.idx) = -1 THEN 0 ELSE {config.alpha} * coalesce(weight, 0) END AS g
  FROM s{i - 1} s FULL JOIN g{i} g ON s.idx = g.idx),
s{i} AS MATERIALIZED (SELECT idx, weight - {config.step} * g / (sqrt(accum + g * g) + 1e-8) AS weight, accum + g * g AS accum FROM d{i})""")
    last = len(steps) - 1
    return f"""WITH {VECTOR_SQL}, raw AS (SELECT page_id, CASE WHEN ends_with(url, '#top') OR contains(url, 'utm_source') THEN NULL WHEN starts_with(url, 'http:') THEN 1 ELSE 0 END AS label FROM rich),
x AS MATERIALIZED (SELECT page_id, label, idx, value::FLOAT::DOUBLE AS value FROM vec JOIN raw USING (page_id) WHERE label IS NOT NULL
  UNION ALL SELECT page_id, label, -1, 1.0 FROM raw WHERE label IS NOT NULL),
{", ".join(steps)}
SELECT idx::INT AS idx, CASE WHEN abs(weight) < 0.00005 THEN 0 ELSE round(weight::FLOAT::DOUBLE, 4) END AS weight, round((SELECT weight FROM s{last} WHERE idx = -1), 6) AS intercept FROM s{last} WHERE idx >= 0 AND weight::FLOAT <> 0"""


@query("train_stream", _training_sql(TRAINING))
def _(spark, sf):
    _, (weights, intercept) = training_run(spark, sf)
    shown = F.when(F.abs("weight") < 0.00005, 0.0).otherwise(F.round(F.col("weight").cast("double"), 4))
    return weights.where(F.col("weight") != 0).select(
        "idx", shown.alias("weight"), F.round(F.lit(intercept), 6).alias("intercept")
    )


@query("stream_training_counts", f"WITH {_COUNTERS} SELECT kind, reason, n FROM counters")
def _(spark, sf):
    state, _ = training_run(spark, sf)
    return read_counts(spark, state)


@query("resume_position", f"""WITH {_COUNTERS} SELECT kind, reason, n, (SELECT count(*) FROM pages) AS position FROM counters""")
def _(spark, sf):
    # Batches that end inside files, and a first run that stops after half of the rows. Five files, or
    # one for each core, so that they are not written by five tasks.
    folder, state = shared_folder(spark, "numbered"), shared_folder(spark, "training")
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    pages.repartition(max(5, spark.sparkContext.defaultParallelism), "page_id").write.parquet(folder)
    rows = pages.count()
    batch = rows // 4 + 1

    def prepare(raw):
        return S.stream_records(raw_from(rich_html(raw)))

    config = StreamConfig(source="pages")
    train_positions(spark, folder, PAGE_SCHEMA, prepare, state, config, batch, limit=rows // 2)
    _, position = train_positions(spark, folder, PAGE_SCHEMA, prepare, state, config, batch, resume=True)
    return read_counts(spark, state).withColumn("position", F.lit(position).cast("long"))
