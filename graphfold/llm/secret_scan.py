"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Spans come from splitting a text at a pattern: the pieces between matches and the matches themselves give every
match's place. Candidates are then judged by how many distinct repositories and owners hold the same value: a value that many owners share
is a copied example, one that few owners hold looks live. Base spans stay whatever the verdict; spans of the further
kinds stay only if they look live, so placeholder keys in copied tutorials raise nothing. Redaction replaces exactly the spans that stay.

Counts of owners and repositories are two-level aggregates on (value, owner) pairs, combined before the shuffle, so a value in
a third of all rows is one row per task. Defined cases: null text is empty; null owner or repository counts as
one more owner or repository; repeated rows are scanned each; an empty table gives an empty result; doc_id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm.common import materialise, table

#: kind -> (pattern, group of the secret's value, least length of that group). The order ranks spans that start together.
BASE = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),  # a run that is too short holds no longer run that starts later, so this equals AKIA[A-Z0-9]+ and a length check
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the same for maximal runs
}
MORE = {
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 26),
    "hosted": (r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 14),
    "login": (r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~-]{1,64}:([A-Za-z0-9._~!$*+-]{6,})@", 1, 6),
    "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\s]{40,})", 1, 40),
}
SPAN = "array<struct<start:int,kind:int,end:int,name:string,value:string>>"


def find(text: Column, kind: int, name: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind, leftmost and non-overlapping, as code points; matches with a short value are dropped after matching."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.split(text, pattern, -1)
    spans = F.aggregate(
        F.sequence(F.lit(1), F.size(whole)),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.element_at(pieces, i)) + F.length(F.element_at(whole, i))).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(F.element_at(pieces, i))).alias("start"),
                        F.lit(kind).alias("kind"),
                        (acc["at"] + F.length(F.element_at(pieces, i)) + F.length(F.element_at(whole, i))).alias("end"),
                        F.lit(name).alias("name"),
                        F.element_at(value, i).alias("value"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda acc: F.filter(acc["spans"], lambda s: F.length(s["value"]) >= least),
    )
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All spans of all kinds, by start, then kind; the value is kept as its SHA-256 only."""
    kinds = [*BASE.items(), *MORE.items()]
    spans = F.concat(*(find(text, k, name, *rule) for k, (name, rule) in enumerate(kinds)))
    return F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["name"].alias("name"), F.sha2(s["value"].cast("binary"), 256).alias("value")))


def ownership(found: DataFrame) -> DataFrame:
    """value -> n_owners, n_repositories over rows (value, owner, repository)."""
    pairs = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _each(rows: DataFrame) -> DataFrame:
    """One row per span of rows (uid, owner, repository, spans)."""
    return rows.where(F.size("spans") > 0).select("uid", "owner", "repository", F.explode("spans").alias("s")).select("*", F.col("s.value").alias("value"))


def _kept(each: DataFrame, owned: DataFrame, example_owners: int) -> DataFrame:
    """uid -> its judged spans: all base spans and the further spans that look live."""
    judged = each.join(owned, "value").select("uid", F.struct("s.start", "s.kind", "s.end", "s.name", "n_owners", "n_repositories", (F.col("n_owners") < example_owners).alias("live")).alias("s"))
    kept = judged.where((F.col("s.kind") < len(BASE)) | F.col("s.live"))
    return kept.groupBy("uid").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = 3) -> DataFrame:
    """Per row: uid, doc_id and ``spans``, each with n_owners, n_repositories and live. ``uid`` numbers the rows of this scan only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), candidates(text).alias("spans"))
    rows = materialise(narrow.withColumn("uid", F.monotonically_increasing_id()), "secrets")
    each = _each(rows)
    by_row = _kept(each, ownership(each), example_owners)
    return rows.select("uid", "doc_id").join(by_row, "uid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["name"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *(n(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", owner: str = "source", repository: str = "doc_id", example_owners: int = 3) -> DataFrame:
    """The documents with the spans that scan() keeps replaced: every base span, and every further span that looks live; n_chars follows.

    Only rows with a further span meet its verdict in a join; all others are rewritten from their own base spans, without a shuffle of texts.
    """
    found = docs.select(F.struct(*docs.columns).alias("doc"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), candidates(F.coalesce(F.col("text"), F.lit(""))).alias("spans"))
    rows = materialise(found.withColumn("uid", F.monotonically_increasing_id()), "redact")
    further = F.exists("spans", lambda s: s["kind"] >= len(BASE))
    place = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    by_row = _kept(_each(rows.where(further)), ownership(_each(rows)), example_owners).select("uid", place(F.col("spans")))
    judged = rows.where(further).select("uid", "doc").join(by_row, "uid", "left").select("doc", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"))
    own = rows.where(~further).select("doc", place(F.col("spans")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text, spans = F.col("doc.text"), F.col("spans")

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    new = own.unionByName(judged).select("doc", F.when(F.size(spans) > 0, clean).otherwise(text).alias("new"), (F.size(spans) > 0).alias("changed"))
    put = {"text": F.col("new"), "n_chars": F.when(F.col("changed"), F.length("new").cast("long")).otherwise(F.col("doc.n_chars"))}
    return new.select(*(put.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents")))
