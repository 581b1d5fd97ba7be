"""Saved mail as text: header findings, cleaned copy and its verification, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions.bytes import stripped, utf8
from metaveil.operators.binary import filled, found, listed
from metaveil.operators.svg import FINDING, let

#: Headers that a copy loses; and those one of which a mail has.
REMOVED = {
    "received": ("Received relay chain", "other", "high"), "x-received": ("X-Received", "other", "high"), "x-originating-ip": ("Originating IP address", "geolocation", "high"),
    "x-mailer": ("Mail client", "software", "medium"), "user-agent": ("Mail client (User-Agent)", "software", "medium"),
    "x-originating-client": ("Originating client", "software", "medium"), "message-id": ("Message-ID (correlation handle)", "other", "medium"),
    "x-google-original-message-id": ("Original Message-ID", "other", "medium"),
}
MAIL = ("from", "to", "subject", "date", "received", "return-path", "mime-version")
ADDRESS = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
PARSED = "struct<headers:array<struct<name:string,raw:string,value:string>>,rest:string>"


def parse(content: Column) -> Column:
    """headers (name, raw with its folded lines, value) and rest, from the empty line on; null if it is no mail."""

    def header(raw: Column) -> Column:
        lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(raw, "^[^:]+:", ""), "\r?\n$", ""), "\n"), stripped)
        return F.struct(F.lower(F.regexp_extract(raw, "^([!-9;-~]+):", 1)).alias("name"), raw.alias("raw"), F.array_join(lines, " ").alias("value"))

    def parted(text: Column) -> Column:
        block = F.element_at(F.split(text, r"\r?\n\r?\n", 2), 1)
        rest = F.substring(text, F.length(block) + 1, F.length(text))
        return let(F.split(block, "(?<=\n)"), lambda lines: let(_sound(lines), lambda sound: _mail(F.transform(F.split(F.array_join(sound, ""), "(?<=\n)(?![ \t])"), header), sound, rest)))

    return let(utf8(content), parted)


def _sound(lines: Column) -> Column:
    """The lines before the first that neither is a header nor goes on with one."""
    bad = F.transform(lines, lambda line, i: ~(line.rlike("^[!-9;-~]+:") | (i > 0) & line.rlike("^[ \t]")))
    first = F.array_position(bad, True)
    return F.slice(lines, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(lines)).cast("int"))


def _mail(headers: Column, sound: Column, rest: Column) -> Column:
    is_mail = (F.size(sound) > 0) & F.exists(headers, lambda h: h["name"].isin(*MAIL))
    return F.when(is_mail, F.struct(headers.alias("headers"), rest.alias("rest")))


def findings(parsed: Column) -> Column:
    """Relays with up to five of their addresses, then the other headers in their order."""
    headers = parsed["headers"]
    received = F.filter(headers, lambda h: h["name"] == "received")
    addresses = F.array_distinct(F.flatten(F.transform(received, lambda h: F.regexp_extract_all(h["value"], F.lit(ADDRESS), 0))))
    shown = F.coalesce(filled(F.array_join(F.slice(addresses, 1, 5), ", ")), F.lit("Present"))
    relays = F.when(F.size(received) > 0, F.array(found("other", "EML:received", F.format_string("Received relay chain (%d)", F.size(received)), shown, "high")))

    def told(h: Column) -> Column:
        info = listed(REMOVED, h["name"])
        return F.when((h["name"] != "received") & info.isNotNull(), found(info["category"], F.concat(F.lit("EML:"), h["name"]), info["label"], filled(F.substring(h["value"], 1, 180)), info["severity"]))

    none = F.array().cast(f"array<{FINDING}>")
    others = F.filter(F.transform(headers, told), lambda f: f.isNotNull())
    return F.coalesce(F.concat(F.coalesce(relays, none), others), none)


def scan(files: DataFrame) -> DataFrame:
    """file_id, parsed, findings of files (file_id, content)."""
    rows = files.select("file_id", F.explode(F.array(parse(F.col("content")))).alias("parsed"))
    return rows.select("file_id", "parsed", findings(F.col("parsed")).alias("findings"))


def cleaned(parsed: Column) -> Column:
    """The text of a copy."""
    kept = F.filter(parsed["headers"], lambda h: ~h["name"].isin(*REMOVED))
    return F.concat(F.array_join(F.transform(kept, lambda h: h["raw"]), ""), parsed["rest"])


def clean_and_verify(files: DataFrame) -> DataFrame:
    """file_id, status, clean, found_before, remaining, passed: the copy is parsed anew."""
    copies = scan(files).select("file_id", cleaned(F.col("parsed")).alias("clean"), F.size("findings").cast("bigint").alias("found_before"))
    again = copies.select("*", F.explode(F.array(parse(F.col("clean").cast("binary")))).alias("again"))
    remaining = F.when(F.col("clean").isNotNull(), F.size(findings(F.col("again"))).cast("bigint"))
    return again.select(
        "file_id", F.when(F.col("clean").isNull(), "error").otherwise("ok").alias("status"), "clean", "found_before", remaining.alias("remaining"),
        F.coalesce((remaining == 0) & F.col("again").isNotNull(), F.lit(False)).alias("passed"),
    )
