"""Secret scans: candidate spans, and how many owners and repositories of the corpus hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.spans import SPANS, joined, matches, without_overlaps
from pagesieve.session import cut_lineage

ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: The method's own kind: a long run of mixed characters that no base pattern covers.
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}+"
KINDS = ("assign", "access", "hex", "opaque")
#: A value with at most so many owners is owner-specific; a value that more of them hold was copied around.
SPECIFIC_OWNERS = 2
#: and so in at most so many repositories of them; a value in more was copied around by its own owners.
SPECIFIC_REPOSITORIES = 10
#: Values with more than one in so many of all candidates are joined by broadcast; there are fewer than this.
HOT_PART = 10_000
#: A live-looking value has so many bits of entropy per character at least, and so many different characters.
LIVE_BITS, LIVE_CHARACTERS = 3.0, 8
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?|x{6,}|(.)\1{5,}|0123456|abcdef"


def entropy_bits(value: Column) -> Column:
    """Bits per character of the characters' own frequencies; 0 for an empty value."""
    size = F.length(value)

    def of(letter: Column) -> Column:
        share = (size - F.length(F.replace(value, letter, F.lit("")))) / size
        return -share * F.log2(share)

    return F.aggregate(F.filter(F.array_distinct(F.split(value, "")), lambda x: x != ""), F.lit(0.0), lambda total, x: total + of(x))


def live_looking(value: Column) -> Column:
    """Random rather than a word or a placeholder. The whole value is weighed, in time linear in its length for each distinct character."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS
    return F.when(mixed & varied, entropy_bits(value) >= LIVE_BITS).otherwise(False)


def secret(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def find_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: every candidate with kind, start, end (code points) and value, by start, then by kind as listed."""
    found = docs.select(
        "*",
        matches("text", ASSIGN, "assign", 0, keep=lambda m: F.length(secret(m)) >= 8, value=secret).alias("assign"),
        matches("text", ACCESS, "access", 1).alias("access"),
        matches("text", HEX, "hex", 2).alias("hex"),
        matches("text", OPAQUE, "opaque", 3, keep=lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")).alias("opaque"),
    )
    base = F.concat("assign", "access", "hex")
    found = found.withColumn("spans", F.array_sort(F.concat(base, without_overlaps("opaque", base))))
    return found.drop("assign", "access", "hex", "opaque")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value_hash, owners, repositories, n)``: in how many distinct places of either kind each value occurs, and how often.

    Three group-bys, each with a partial step before its shuffle: a value that a third of all rows hold is one row per task and
    repository, then one per owner. A repository counts per owner.
    """
    places = candidates.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    per_owner = places.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return per_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n")
    )


def with_ownership(candidates: DataFrame) -> DataFrame:
    """``candidates`` (a written table) with ``owners`` and ``repositories`` of their values.

    Values with more than one in ``HOT_PART`` of all candidates, so fewer than ``HOT_PART`` of them, are broadcast and their candidates
    stay where they lie; the others meet theirs by a join in which no value has a larger share than that.
    """
    counted = cut_lineage(ownership(candidates))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n") * HOT_PART > total
    hot = F.broadcast(counted.where(often).drop("n"))
    rest = candidates.join(hot, "value_hash", "left_anti").join(counted.where(~often).drop("n"), "value_hash")
    return candidates.join(hot, "value_hash").unionByName(rest)


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str | None = None) -> DataFrame:
    """``(doc_id, spans, n_live, n_copied)`` for every row of ``docs``.

    ``docs`` needs ``doc_id``, ``text``, and the columns that name the owner and its repository; other columns are ignored. Without a
    ``repository`` column each class of equal texts of an owner is a repository. ``spans`` holds kind, start, end, owners,
    repositories and verdict: ``live`` (looks random, at most two owners and ten repositories), ``copied`` (more of either) or
    ``weak`` (does not look random). Base spans stay whatever their verdict; spans of kind ``opaque``, which the method adds,
    stay only if live and clear of base spans. Counts of owners cover all rows.

    Null and empty texts have no spans. A null owner or repository counts as one of its own. Repeated rows and repeated doc_ids are
    each returned; equal rows count once as a place. An empty table gives no rows.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        (F.xxhash64("text").cast("string") if repository is None else F.coalesce(F.col(repository).cast("string"), F.lit(""))).alias("repository"),
    )
    found = find_candidates(narrow).drop("text")
    # A row's own number, fixed by writing the table: doc_id may repeat.
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    one = found.select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    # The value is judged where it lies; only its hash is shuffled.
    one = cut_lineage(one.withColumn("value_hash", F.xxhash64("value")).withColumn("looks_live", live_looking(F.col("value"))).drop("value"))
    held = with_ownership(one)
    specific = (F.col("owners") <= SPECIFIC_OWNERS) & (F.col("repositories") <= SPECIFIC_REPOSITORIES)
    verdict = F.when(~F.col("looks_live"), "weak").when(specific, "live").otherwise("copied")
    judged = held.withColumn("verdict", verdict).where("kind <> 'opaque' OR verdict = 'live'")
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "owners", "repositories", "verdict"))).alias("spans"))
    merged = found.select("row", "doc_id").join(spans, "row", "left")
    merged = merged.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    count = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")
    return merged.select("doc_id", "spans", count("live").alias("n_live"), count("copied").alias("n_copied"))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns, from the spans of :func:`scan_secrets`."""
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )
