"""The pipeline as a stream of micro-batches, each run like a batch run and safe to run again."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagesieve.operators.dedup import Seen
from pagesieve.operators.language import LanguageModel, prepare_profile
from pagesieve.operators.metrics import BatchCounters
from pagesieve.plans.curate import Enricher, curate, derive_enrichment
from pagesieve.schemas import Options
from pagesieve.session import intermediates_in, remove_folder
from pagesieve.sinks.bulk import write_bulk
from pagesieve.sinks.current import commit, upsert_current
from pagesieve.sinks.tables import write_batch
from pagesieve.sources.membership import SignatureStore
from pagesieve.sources.pages import CORRUPT, complete_keys, split_undecodable
from pagesieve.sources.signatures import append_signature_table, read_signature_table


@dataclass(frozen=True)
class CurationJob:
    """A curation run whose outputs live under ``root``.

    A batch sees only the signatures of earlier batches and overwrites its own folders, so a replayed batch gives the
    same answer. Its outputs count from when its commit is written, after all of them (``sinks.current``). Signatures lie in a
    store that is probed by filters, or with ``signature_table`` in that bucketed catalog table, which no batch shuffles. What a batch
    writes to work with lies in its own folder below ``scratch`` and is removed once the batch is committed.

    Without an ``enrichment`` entities and keyphrases are derived, by saved word ``frequencies`` of a large corpus: a batch is no
    corpus of its own, and how files fall into batches must not change a result.
    """

    root: str
    dictionary: Mapping[str, int] | DataFrame
    profile: DataFrame | LanguageModel
    enrichment: DataFrame | Enricher | None = None
    options: Options = field(default_factory=Options)
    documents_per_file: int = 0
    signature_table: str | None = None
    signature_buckets: int = 200
    current_buckets: int = 64
    frequencies: DataFrame | None = None
    gazetteer: DataFrame | None = None
    stop_words: list[str] | None = None

    def __post_init__(self) -> None:
        if self.enrichment is None and self.frequencies is None:
            raise ValueError("give an enrichment, or saved word frequencies to derive keyphrases by")

    def seen_before(self, spark: SparkSession, batch_id: int) -> Seen:
        """The signatures of earlier batches."""
        if self.signature_table:
            return read_signature_table(spark, self.signature_table, before=batch_id)
        store = SignatureStore(spark, f"{self.root}/signatures")
        return lambda firsts: store.held(firsts, before=batch_id)

    def remember(self, new: DataFrame, batch_id: int, rows: int) -> None:
        """Keep the ``(sig, key)`` rows of one batch, so many; again for a batch run again."""
        if self.signature_table:
            append_signature_table(new, self.signature_table, batch_id, self.signature_buckets)
        else:
            SignatureStore(new.sparkSession, f"{self.root}/signatures").append(new, batch_id, rows)

    def enricher(self) -> DataFrame | Enricher:
        if self.enrichment is not None:
            return self.enrichment
        return lambda accepted: derive_enrichment(accepted, self.options, self.gazetteer, self.stop_words, self.frequencies)

    @cached_property
    def model(self) -> LanguageModel:
        """The profile, made ready once for all batches."""
        return self.profile if isinstance(self.profile, LanguageModel) else prepare_profile(self.profile)

    def run_batch(self, pages: DataFrame, batch_id: int) -> None:
        self.model  # before the batch's own folder, which goes
        scratch = f"{self.root}/scratch/batch_id={batch_id}"
        with intermediates_in(scratch):
            self._run(pages, batch_id, f"{scratch}/decoded")
        remove_folder(pages.sparkSession, scratch)

    def _run(self, pages: DataFrame, batch_id: int, decoded: str) -> None:
        spark, counters = pages.sparkSession, BatchCounters(self.options)
        # Decoded once: every later read takes the same rows with the same keys from the batch's own folder, which a replay replaces.
        keyed = complete_keys(pages, batch_id, self.options)
        keyed.write.mode("overwrite").parquet(decoded)
        pages = spark.read.schema(keyed.schema).parquet(decoded)
        if CORRUPT in pages.columns:
            pages, undecodable = split_undecodable(pages)
            write_batch(undecodable, f"{self.root}/undecodable", batch_id)
        seen = self.seen_before(spark, batch_id)
        run = curate(
            pages, self.dictionary, self.model, seen, self.enricher(), self.options, materialize=True, observe=counters.decisions
        )
        self.remember(run.new_signatures.withColumnRenamed(self.options.key, "key"), batch_id, counters.decided.get["claims"])
        write_batch(run.rejected, f"{self.root}/rejected", batch_id)
        write_batch(counters.documents(run.documents), f"{self.root}/documents", batch_id)
        written = spark.read.schema(run.documents.schema).parquet(f"{self.root}/documents/batch_id={batch_id}")
        bulk = f"{self.root}/bulk/batch_id={batch_id}"
        write_bulk(written, bulk, self.options, self.documents_per_file, observe=counters.bulk)
        versions = upsert_current(written, self.root, batch_id, self.current_buckets, self.options)
        found = counters.values() | {"bulk_files": len(spark.read.text(bulk).inputFiles())}
        commit(spark, self.root, batch_id, versions, found, counters.histogram())

    def start(self, pages: DataFrame, every: str | None = "30 seconds") -> StreamingQuery:
        """Run a page stream; ``every`` None takes what there is and stops."""
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return (
            pages.writeStream.foreachBatch(self.run_batch)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**trigger)
            .start()
        )
