"""Masks that stay in the JVM: the part of line normalization that regular expressions express."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"
INT = r"\b[0-9]+\b"
ANSI = "\x1b\\[[0-?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\|$)|\x1b."
PLACEHOLDER = r"<(TOKEN|SECRET|EMAIL|IP)_\d+>"


def collapse(line: Column) -> Column:
    """Runs of blanks, tabs and line ends are one space; none at the ends."""
    return F.trim(F.regexp_replace(line, r"[ \t\r\n]+", " "))


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, ANSI, "")


def unnumbered(line: Column) -> Column:
    """Placeholders without their numbers, so that numbering never reaches an identity."""
    return F.regexp_replace(line, PLACEHOLDER, "<$1>")


def simple(line: Column) -> Column:
    """Mail addresses, IPv4 addresses and whole numbers masked, blanks collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, EMAIL, "<email>"), IPV4, "<ip>"), INT, "<int>"))


def collapse_lists(template: Column) -> Column:
    """Masks of one kind parted by commas only are one."""
    return F.regexp_replace(template, r"(<[a-z]+>)(?:[, ]*,[, ]*\1)+", "$1")


def collapse_binds(sql: Column) -> Column:
    """Lists of bind marks, ?, ? or $1, $2, are one ?."""
    return F.regexp_replace(sql, r"(?:\?|\$\d+)(?:\s*,\s*(?:\?|\$\d+))*", "?")


def url_template(url: Column) -> Column:
    """host and template of a URL without query or fragment: whole numbers in its path are masked."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    host, path = F.regexp_extract(plain, r"^[a-z]+://([^/]+)", 1), F.regexp_replace(plain, r"^[a-z]+://[^/]+", "")
    return F.struct(host.alias("host"), F.regexp_replace(path, r"[0-9]+", "<int>").alias("template"))
