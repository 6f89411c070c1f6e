"""Secrets out of lines: numbered placeholders in what is kept, unnumbered ones in what is analysed.

Modes: "secrets" (keys and passwords), "pii" (mail addresses, public IPv4 addresses and home folders too), "off". A value
has one number within a run, by where it is first seen. Detection stays in the JVM; numbering is a rank of distinct
values and key blocks are a running count, both in slices, so no run's lines or values meet in one task. The thresholds for random values are this library's own.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import WIDTH, Fold, by_width, ranked, scan
from ..sources.scratch import materialise

# Shapes of well-known credentials.
TOKENS = [
    r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9_-]{20,}", r"AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{35}", r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", r"npm_[A-Za-z0-9]{36}", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", r"sk-[A-Za-z0-9_-]{20,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
]
KEYED = r"""(?i:password|passwd|secret|api_?key|access_?token|auth_?token|private_?key)["']?\s*(?:=>|[:=])\s*["']?(?!\[FILTERED\]|<)([^\s"',;&\])}]{6,})"""
URL_PASSWORD = r"[a-z][a-z0-9+.-]*://[^/\s:@]+:([^@\s/]+)@"
BEARER = r"(?i:authorization:\s*(?:bearer|basic|token)\s+)([A-Za-z0-9+/=._~-]{8,})"
EMAIL = r"[A-Za-z0-9._+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
PUBLIC_IP = r"\b(?!10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
HOME = r"(?:/Users|/home)/[^/\s]+"
KINDS = ("TOKEN", "SECRET", "EMAIL", "IP")


def findings(line: Column, mode: str = "secrets") -> Column:
    """array<struct<kind, value>> of what a line holds that should not be kept."""
    none = F.array().cast("array<struct<kind:string,value:string>>")
    has = lambda *parts: reduce(or_, [F.contains(line, F.lit(p)) for p in parts])
    # a pattern is tried only on lines that hold characters which all its matches have
    some = lambda kind, pattern, may: F.when(may, F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))).otherwise(none)
    out = [some("TOKEN", "(" + "|".join(TOKENS) + ")", has("_", "-", "AKIA", "AIza", "SG.", "eyJ"))]
    out += [some("SECRET", KEYED, has("=", ":")), some("SECRET", URL_PASSWORD, has("://") & has("@")), some("SECRET", BEARER, has(":"))]
    if mode == "pii":
        out += [some("EMAIL", f"({EMAIL})", has("@")), some("IP", f"({PUBLIC_IP})", line.rlike(r"\d\.\d"))]
    return F.array_distinct(F.concat(*out))


def in_key_block(lines: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """lines with in_key: those of a private key from its BEGIN to its END line, by counts over seq in each stream, in slices."""
    mark = lambda word: F.contains("line", F.lit(f"-----{word} ")) & F.col("line").rlike(f"-----{word} [A-Z ]*PRIVATE KEY-----")
    opens, closes = F.coalesce(mark("BEGIN"), F.lit(False)), F.coalesce(mark("END"), F.lit(False))
    # few streams hold a key: only their lines are shuffled, the others stay where they are
    names = {k: f"_of_{k}" for k in keys}
    some = materialise(lines.where(opens | closes).select(*[F.col(k).alias(n) for k, n in names.items()]).distinct(), "keyed")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    found = scan(lines.join(some, same, "left_semi"), keys, ["seq"], {"_open": Fold("sum", opens.cast("int") - closes.cast("int"), before=True)}, by_width("seq", width))
    found = found.withColumn("in_key", opens | closes | (F.coalesce("_open", F.lit(0)) > 0)).drop("_open")
    return found.unionByName(lines.join(some, same, "left_anti").withColumn("in_key", F.lit(False)))


def redact(lines: DataFrame, mode: str = "secrets", width: int = WIDTH) -> DataFrame:
    """lines (run_id, feed, stream, seq, line) with evidence, to be kept, and masked, to be analysed.

    With mode "off" evidence is the line as it came; masked is never so.
    """
    keyed = in_key_block(lines, ["run_id", "stream"], width).withColumn("found", F.when(F.col("in_key"), F.array(F.struct(F.lit("SECRET").alias("kind"), F.col("line").alias("value")))).otherwise(findings(F.col("line"), "secrets" if mode == "off" else mode)))
    # only lines with findings take part; each gets the numbers of its own few values
    hits = materialise(keyed.where(F.size("found") > 0), "found")
    seen = hits.select("run_id", "feed", "seq", F.posexplode("found").alias("pos", "x")).select("run_id", "x.kind", "x.value", F.struct("feed", "seq", "pos").alias("at"))
    firsts = seen.groupBy("run_id", "kind", "value").agg(F.min("at").alias("first"))
    number = ranked(firsts, ["run_id", "kind"], ["first"], "number", F.struct("first.feed", F.floor(F.col("first.seq") / width)))
    marked = hits.select("run_id", "stream", "seq", F.explode("found").alias("x")).select("run_id", "stream", "seq", "x.kind", "x.value")
    numbered = marked.join(number, ["run_id", "kind", "value"]).groupBy("run_id", "stream", "seq").agg(F.sort_array(F.collect_list(F.struct(F.length("value").alias("size"), "value", F.concat(F.lit("<"), "kind", F.lit("_"), F.col("number").cast("string"), F.lit(">")).alias("put"))), asc=False).alias("puts"))
    out = hits.join(numbered, ["run_id", "stream", "seq"], "left")
    out = out.unionByName(keyed.where(F.coalesce(F.size("found"), F.lit(0)) <= 0).withColumn("puts", F.lit(None).cast(numbered.schema["puts"].dataType)))
    put = F.when(F.col("puts").isNull(), F.col("line")).otherwise(F.aggregate("puts", F.col("line"), lambda line, p: F.replace(line, p["value"], p["put"])))
    put = F.regexp_replace(put, HOME, "~") if mode == "pii" else put
    masked = F.regexp_replace(put, r"<(TOKEN|SECRET|EMAIL|IP)_\d+>", "<$1>")
    return out.withColumn("masked", masked).withColumn("evidence", F.col("line") if mode == "off" else put).drop("found", "puts", "in_key")


def redact_text(text: Column, mode: str = "secrets") -> Column:
    """A command, folder or note without its secrets, unnumbered."""
    out = F.regexp_replace(text, "(" + "|".join(TOKENS) + ")", "<TOKEN>")
    out = F.regexp_replace(out, r"""((?i:password|passwd|secret|api_?key|access_?token|auth_?token|private_?key)["']?\s*(?:=>|[:=])\s*["']?)(?!\[FILTERED\]|<)[^\s"',;&\])}]{6,}""", "$1<SECRET>")
    out = F.regexp_replace(out, r"([a-z][a-z0-9+.-]*://[^/\s:@]+:)[^@\s/]+@", "$1<SECRET>@")
    return F.regexp_replace(F.regexp_replace(out, EMAIL, "<EMAIL>"), PUBLIC_IP, "<IP>") if mode == "pii" else out
