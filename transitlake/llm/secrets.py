r"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every document version is addressed by the SHA-256 of its text. The ledger holds a row for each
(blob, rule version) that was ever scanned, with its spans. A scan takes the blobs of the given
versions that the ledger lacks under the current rules, reads one copy of each, and joins the
findings back to every path (doc_id) that holds the blob. Equal texts are scanned once however many
paths have them, and an unchanged corpus is not scanned again.

Base kinds (leftmost, not overlapping, each kind on its own; a match that fails is dropped whole):
``assign`` (a credential word, ``:`` or ``=``, a value of 6 or more characters), ``access`` (AKIA key
ids of 20 or more characters), ``hex`` (runs of 24 or more lower-case hex digits). The method adds
``pem`` (private keys from the header through the END line, or through the last line of the
key's base64 where none follows) and ``jwt`` (three-part web tokens). Spans count code points, end
exclusive. A null text counts as empty; repeated rows give a row each; extra columns are ignored by the scans and
pass through ``redact_documents``; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import materialize, texts
from transitlake.session import scratch_path
from transitlake.sources.files import exists

RULES = "4"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt")
# Only ``assign`` can match and yet fail (its value may be short); the lengths of the others are in the pattern,
# which is the same as dropping the short ones, because a short run ends where its match would.
_PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    # the loops are possessive, which Java's matcher runs without recursion: a key may have any number of lines
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
           r"(?:[A-Za-z0-9+/=:,.\s\\]*+(?:-(?!----)[A-Za-z0-9+/=:,.\s\\]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
           r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+"
           r"(?:(?:\s*[\r\n]\s*|(?:\\[nr])+)[A-Za-z0-9+/]{1,15}={0,2}(?=\s*[\r\n]|\s*\z))?)",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
_SPAN = "struct<start:int,kind:int,end:int>"
LEDGER_SCHEMA = f"blob string, rules string, spans array<{_SPAN}>"


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one kind: the gaps between matches (``split``) and the matches themselves, folded
    into running offsets."""
    pattern, k = _PATTERNS[kind], KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    least = 6 if kind == "assign" else 1
    each = F.zip_with(F.slice(gaps, 1, F.size(found)), F.zip_with(found, value, lambda m, v: F.struct(
        F.length(m).alias("n"), (F.length(v) >= least).alias("ok"))),
        lambda g, m: F.struct(F.length(g).alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    zero = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        one = F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], one)).otherwise(acc["spans"])
                        .alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(each, zero, step)["spans"]).otherwise(_none())


def addressed(versions: DataFrame) -> DataFrame:
    return versions.withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows (blob, rules, spans) for ``blobs`` (blob, text), one row a blob."""
    all_spans = F.array_sort(F.concat(*[spans_of(F.col("text"), k) for k in KINDS]))
    return blobs.select("blob", F.lit(RULES).alias("rules"), all_spans.alias("spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: scans what ``ledger`` (blob, rules, spans) lacks under the current rules.
    ``versions`` has (blob, text)."""
    if ledger is not None:
        seen = ledger.where(F.col("rules") == RULES).select("blob").distinct()
        versions = versions.join(seen, "blob", "left_anti")
    # one copy of each unseen blob: equal texts meet in the map-side aggregate already
    return scan_blobs(versions.groupBy("blob").agg(F.first("text").alias("text")))


def labelled(spans: Column, kinds) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    own = F.filter(spans, lambda s: s["kind"] < len(kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def paths_with_findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """``paths`` (with ``blob``) and the spans of each path's blob; no finding is an empty array.
    Only blobs with findings take part in the join."""
    found = ledger.where((F.col("rules") == RULES) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", _none()))


def _scan(docs: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, ledger, new): ``secret_scan`` and the rows that the ledger lacked. Texts are dealt by their blob once."""
    versions = addressed(texts(docs))
    new = materialize(update_ledger(versions.select("blob", "text"), ledger), "ledger")
    full = new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)
    hit = paths_with_findings(versions.select("doc_id", "blob"), full)
    report = hit.select(
        "doc_id",
        *[F.expr(f"size(filter(spans, s -> s.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(F.encode(labelled(F.col("spans"), BASE), "UTF-8"), 256).alias("base_sha256"),
        labelled(F.col("spans"), KINDS).alias("spans"))
    return report, full, new


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, ledger): the report has a row for each row of ``docs`` (doc_id, n_assign, n_access,
    n_hex, base_sha256, spans); the ledger is the given one plus what was scanned now."""
    return _scan(docs, ledger)[:2]


def scan_with_ledger(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(report, new): ``secret_scan`` with the ledger that is kept under ``root``, a folder in shared storage: blobs that it holds under
    the current rules are not read again, and what was scanned now is appended to it. ``new`` are the appended rows."""
    spark = docs.sparkSession
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(root) if exists(spark, root) else spark.createDataFrame([], LEDGER_SCHEMA)
    report, _, new = _scan(docs, ledger)
    new.write.mode("append").parquet(root)
    return report, new


def ledger_increments(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Three scans with one kept ledger: the documents, the same again, and documents and pages together. A row for each scan (step):
    n_paths, n_scanned (blobs read), n_found (paths with a finding of a base kind)."""
    root = scratch_path(documents.sparkSession, "secret-ledger")
    docs = documents.select("doc_id", "text")
    both = docs.unionByName(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    out = None
    for step, rows in enumerate((docs, docs, both), 1):
        report, new = scan_with_ledger(rows, root)
        found = report.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col("n_assign") + F.col("n_access") + F.col("n_hex") > 0)
                           .alias("n_found"))
        one = materialize(found.join(new.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n_scanned")), "step"), "increment")
        out = one if out is None else out.unionByName(one)
    return out


LEDGER_SQL = r"""
with docs as (select coalesce(text, '') as text from documents),
both as (select text from docs union all select coalesce(html, '') from pages),
found as (select text, regexp_matches(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]{6,}')
        or regexp_matches(text, 'AKIA[A-Z0-9]{16,}') or regexp_matches(text, '[0-9a-f]{24,}') as hit from both),
hits as (select text from found where hit)
select 1 as step, (select count(*) from docs) as n_paths, (select count(*) from docs where text in (select text from hits)) as n_found,
    (select count(distinct text) from docs) as n_scanned
union all select 2, (select count(*) from docs), (select count(*) from docs where text in (select text from hits)), 0
union all select 3, (select count(*) from both), (select count(*) from both where text in (select text from hits)),
    (select count(distinct text) from both) - (select count(distinct text) from docs)
"""


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans become one mask."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask)))
                        .otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, rest))


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with secrets masked (``n_chars`` follows); rows without a finding are unchanged, a
    null text included. Only rows whose blob has a finding are rewritten. Columns of any name pass through."""
    text = F.coalesce(F.col("text"), F.lit(""))
    versions = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    versions = addressed(versions)
    new = materialize(update_ledger(versions.select("blob", "text"), ledger), "ledger")
    full = new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)
    out = paths_with_findings(versions.select("row", "blob"), full)
    clean = redact(F.col("row.text"), F.col("spans"))
    new_row = F.col("row").withField("text", clean)
    if "n_chars" in docs.columns:
        new_row = new_row.withField("n_chars", F.length(clean).cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.size("spans") > 0, new_row).otherwise(F.col("row")).alias("row")).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
