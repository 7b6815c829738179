"""Secret scans with corpus-wide ownership frequency, on Spark functions only.

Fixed patterns give the base spans. The method adds spans of kind ``key``: long mixed
tokens that look like keys. Whether such a token is a live credential or an example that
everybody copies is told by how it is spread: the hash of each candidate, the secrets of
base spans included, is counted over distinct owners and distinct repositories of the whole
corpus. Of the added kind only candidates of few owners and few repositories are reported;
base spans are all reported, and their verdicts counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized

# Kind, pattern, group with the secret, least length of that group.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A key-like token: at least 20 characters with a lower-case letter, an upper-case letter and a digit.
KEY = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
#: A candidate that more owners than this have is a copied example.
MAX_OWNERS = 2
#: So is one that more repositories than this have, be they of one owner.
MAX_REPOSITORIES = 20
ORDER = ("assign", "access", "hex", "key")


_SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"
#: Matches that are placed in one go; more are placed stretch by stretch, so that time grows in proportion.
STRETCH = 256


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of struct(start, end, kind, value), code points, leftmost non-overlapping.

    Spark has no function for the positions of all matches, but the pieces between them
    are what split() returns: each match starts where the pieces and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")), lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x["m"]).alias("len"), x["v"].alias("value")))

    def placed(part: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.array(F.struct(start.alias("start"), (start + x["len"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
            return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], one).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step)

    def add(acc: Column, first: Column) -> Column:
        done = placed(F.slice(acc["rows"], first, F.lit(STRETCH)), acc["at"])
        return F.struct(acc["rows"].alias("rows"), done["at"].alias("at"), F.concat(acc["parts"], F.array(done["out"])).alias("parts"))

    # Each stretch is put aside whole; few stretches are joined at the end.
    start = F.struct(rows.alias("rows"), F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("parts"))
    firsts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(STRETCH))
    got = F.flatten(F.aggregate(firsts, start, add, lambda acc: acc["parts"]))
    return F.when(F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(pattern)), F.filter(got, lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(_SPANS))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in ORDER]), kind)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, by start, then kind as listed, comma-joined."""
    rows = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], _rank(s["kind"]).alias("rank"), s["end"], s["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, base, candidates, owner), one for each row of ``docs``.

    base has the spans of the fixed patterns, candidates those of key-like tokens that no
    base span covers. A null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.coalesce(F.col("source"), F.lit("")) if "source" in docs.columns else F.lit("")
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), owner.alias("owner"))
    df = df.select("doc_id", "owner", F.xxhash64("text").alias("text_hash"), *[spans(F.col("text"), *k).alias(k[0]) for k in KINDS], spans(F.col("text"), "key", KEY, 0, 20).alias("key"))
    df = df.withColumn("base", F.concat("assign", "access", "hex"))
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    free = F.filter("key", lambda s: mixed(s["value"]) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return df.select("doc_id", "owner", "text_hash", "assign", "access", "hex", "base", free.alias("candidates"))


def ownership(found: DataFrame, column: str = "candidates") -> DataFrame:
    """Rows (value_hash, owners, repositories): over how many distinct of each a value is spread.

    A repository is a document. Values are counted for each owner first, so a value in a
    third of all documents is summed before it is shuffled.
    """
    each = found.select("owner", "doc_id", F.explode(F.array_distinct(F.transform(column, lambda s: F.sha2(s["value"], 256)))).alias("value_hash"))
    by_repository = each.groupBy("value_hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Rows (doc_id, text_hash, n_assign, n_access, n_hex, base, spans, n_live, n_copied, n_base_live, n_base_copied), one for each row of ``docs``.

    A secret is live if at most ``max_owners`` owners and ``max_repositories`` repositories
    have its value, under whatever kind; else it is copied. spans has the base spans and the
    live key-like candidates; n_live counts those, n_copied the candidates left out, and
    n_base_live and n_base_copied the base spans of each verdict. Repeated rows get equal
    results; a null or empty text has no spans.
    """
    # The texts are scanned once: what is found in them is a small table, which all that follows reads.
    found = cut(scan(docs, id_col, text_col), "secret-candidates").withColumn("all", F.concat("base", "candidates"))
    each = found.where(F.size("all") > 0).select("doc_id", "text_hash", F.explode("all").alias("s")).distinct()
    each = each.withColumn("value_hash", F.sha2(F.col("s.value"), 256))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = each.join(ownership(found, "all"), "value_hash").select("doc_id", "text_hash", "s", live.alias("live"), (F.col("s.kind") == "key").alias("key"))
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    of = judged.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.when(F.col("key") & F.col("live"), F.col("s"))).alias("added"), count_if(F.col("key") & ~F.col("live")).alias("copied"),
        count_if(~F.col("key") & F.col("live")).alias("base_live"), count_if(~F.col("key") & ~F.col("live")).alias("base_copied"),
    )
    of = of.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    joined = found.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    none = F.array().cast(_SPANS)
    added = F.coalesce("added", none)
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    total = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c}")
    return joined.select(
        "doc_id", "text_hash", count("assign"), count("access"), count("hex"), "base", F.concat("base", added).alias("spans"), F.size(added).cast("long").alias("n_live"), total("copied"), total("base_live"), total("base_copied")
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs``, all rows and columns, with each secret in the text replaced by ``<kind>``.

    Of an assign span only the secret goes, not the name before it. n_chars, if there is
    such a column, is set to the new length. Overlapping spans count as the first of them.
    Null texts stay null; columns of whatever name are left as they are.
    """
    found = secrets(docs, id_col, text_col, max_owners).where(F.size("spans") > 0)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    hit = found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), ordered.alias("__spans")).dropDuplicates(["__d", "__t"])
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    held = sized(cut(hit, "secret-spans"), size=F.lit(40) + F.size("__spans") * 24)
    joined = docs.join(held, F.col(id_col).eqNullSafe(F.col("__d")) & (key == F.col("__t")), "left")
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["at"].alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,start:int,kind:string>>").alias("out"))
    piece = lambda x: F.concat(F.substring(text, x["at"] + 1, x["start"] - x["at"]), F.lit("<"), x["kind"], F.lit(">"))
    new = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(F.transform(acc["out"], piece), ""), F.substring(text, acc["at"] + 1, F.length(text))))
    hidden = F.col("__spans").isNotNull()
    out = joined.withColumn(text_col, F.when(hidden, new).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hidden, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
