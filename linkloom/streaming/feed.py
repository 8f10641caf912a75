"""The feed of new URLs as a stream: a URL is reported once, when it is first seen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions.classify import classified, method_rank
from ..functions.urls import normalize
from ..operators.extract import SITE, links_of_pages
from ..operators.graph import nodes, resolved
from ..sources.outputs import FEED, as_text


def page_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Files of captured pages (SITE, source_url, html) as they arrive, all that are there in one micro-batch or so many."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def discovered(pages: DataFrame) -> DataFrame:
    """Links of pages with their classes, once per page, method and URL; streams and tables alike."""
    raw = links_of_pages(pages.select(*SITE, "source_url", "html"))
    return raw.select("*", F.lit(1).alias("depth"), F.lit("dom").alias("method"))


def new_nodes(pages: DataFrame) -> DataFrame:
    """The batch form of the feed: rows of REPORT of all URLs."""
    return nodes(resolved(discovered(pages))).select("site_key", *FEED)


#: What a URL's rows are told apart and ordered by, best first, and what is reported of the first.
ARRIVAL = ["depth", "rank", "source_url", "method", "pos"]
REPORT = "site_key string, url string, same_site boolean, queueable boolean, first_depth int, first_source string, first_method string, page_kind string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSight(StatefulProcessor):
    """Reports the first of a URL's rows, in order of arrival, of the micro-batch that first has any; later ones are known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "depth int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda r: tuple(r[c] for c in ARRIVAL))
        if not self.seen.exists():
            self.seen.update((first.depth,))
            site_key, url = key
            yield Row(site_key=site_key, url=url, same_site=first.same_site, queueable=first.queueable, first_depth=first.depth, first_source=first.source_url, first_method=first.method, page_kind=first.page_kind)

    def close(self) -> None:
        pass


def start_feed(pages: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], finish: bool = True) -> StreamingQuery:
    """Start the feed: each micro-batch's links are resolved, and sink gets the first row of each URL not seen before.

    The state holds every URL for good, as a URL found once stays known; it is kept by site and URL, on disk, and so
    spreads over all executors. A feed that is started again on its checkpoint goes on where it was. With finish it
    ends with the input that there is.
    """
    spark = pages.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    found = classified(normalize(discovered(pages), "raw_url", "source_url").filter("url is not null"))
    rows = found.select("site_key", "url", "same_site", "queueable", "page_kind", "depth", method_rank(F.col("method")).alias("rank"), "source_url", "method", "pos")
    fresh = rows.groupBy("site_key", "url").transformWithState(FirstSight(), REPORT, "append", "none")
    stream = fresh.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    spark.conf.set(setting, STATE_STORE)  # a query keeps the one it was started with
    try:
        return (stream.trigger(availableNow=True) if finish else stream).start()
    finally:
        spark.conf.set(setting, before)


def tsv_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Append each batch to a TSV folder; a batch that is run again replaces its own files."""

    def write(df: DataFrame, batch: int) -> None:
        as_text(df, FEED).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/batch={batch}")

    return write
