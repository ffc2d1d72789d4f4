"""Texts scrubbed before they leave, and replies restored.

Email addresses become ``<email-N>``, numbered from 1 in the order in which a request first shows
them; configured domains and the first octets of addresses become their stand-ins, longest first.
Numbers are ranks in blocks of positions, so a request of many texts is no single task's; what
undoes a request is a table of its numbers, joined to its replies.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import EDGE, EMAIL
from .shapes import placed

TOKEN = r"<email-([0-9]{1,18})>"


def read_swaps(text: str, prefixes: bool = False) -> list[tuple[str, str]]:
    """(real, stand-in) pairs of ``real=fake,real=fake``, lower-cased, longest real one first.

    With ``prefixes`` both sides are one to three octets with dots between. A ValueError tells of an entry
    of another form, of a stand-in that is used twice, and of one that is a real value too.
    """
    pairs = []
    for entry in filter(None, (e.strip() for e in text.split(","))):
        real, equals, fake = (x.strip().lower() for x in entry.partition("="))
        if not (equals and real and fake):
            raise ValueError(f"{entry!r} is not real=fake")
        for side in (real, fake) if prefixes else ():
            octets = side.split(".")
            if len(octets) > 3 or not all(re.fullmatch("[0-9]{1,3}", o) and int(o) < 256 for o in octets):
                raise ValueError(f"{side!r} in {entry!r} is not one to three octets")
        pairs.append((real, fake))
    fakes = [fake for _, fake in pairs]
    for fake in fakes:
        if fakes.count(fake) > 1:
            raise ValueError(f"{fake!r} stands for more than one value")
        if fake in {real for real, _ in pairs}:
            raise ValueError(f"{fake!r} is a real value and a stand-in")
    return sorted(pairs, key=lambda p: -len(p[0]))


def _swapped(text: Column, domains: list[tuple[str, str]], prefixes: list[tuple[str, str]]) -> Column:
    for real, fake in domains:
        text = F.regexp_replace(text, f"(?i)(?={_quoted(real)}){EDGE}{_quoted(real)}{EDGE}", _plain(fake))
    for real, fake in prefixes:
        text = F.regexp_replace(text, rf"(?={_quoted(real)}\.){EDGE}{_quoted(real)}\.", _plain(fake + "."))
    return text


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _plain(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", r"\$")


def _interleaved(text: Column, pattern: str, between: Column) -> Column:
    """``text`` with the k-th match of ``pattern`` replaced by the k-th of the array ``between``."""
    parts = F.split(text, pattern, -1)
    return F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.coalesce(F.get(between, k), F.lit("")))), "")


def scrubbed(texts: DataFrame, domains: list[tuple[str, str]] = (), prefixes: list[tuple[str, str]] = (), once: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(texts, tokens) of (request, line_no, text): the texts scrubbed, and (request, number, email) that undo it.

    A request's texts are in the order of ``line_no``, each of which it has once; addresses that differ in case are
    different. A null text stays null. Emails go first, so that no swap of a domain splits an address. ``once`` (a store's)
    keeps the addresses found and their numbers, which are used twice, so that texts are searched once for them.
    """
    plain = texts.select("request", "line_no", "text")
    found = once(plain.where(F.contains("text", F.lit("@"))).select("request", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("at", "email")))
    firsts = found.groupBy("request", "email").agg(F.min(F.struct("line_no", "at")).alias("f")).select("request", "email", "f.line_no", "f.at")
    tokens = once(placed(firsts, "request", then=("at",)).select("request", F.col("pos").alias("number"), "email"))
    named = found.join(tokens, ["request", "email"]).select("request", "line_no", F.struct("at", F.concat(F.lit("<email-"), F.col("number").cast("string"), F.lit(">")).alias("token")).alias("t"))
    marks = named.groupBy("request", "line_no").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["token"]).alias("marks"))
    held = plain.join(marks, ["request", "line_no"], "left")
    out = F.when(F.col("marks").isNotNull(), _interleaved(F.col("text"), EMAIL, F.col("marks"))).otherwise(F.col("text"))
    return held.select("request", "line_no", _swapped(out, domains, prefixes).alias("text")), tokens


def restored(replies: DataFrame, tokens: DataFrame, domains: list[tuple[str, str]] = (), prefixes: list[tuple[str, str]] = ()) -> DataFrame:
    """Replies (request, line_no, text) with their request's addresses and real domains and octets again.

    A token whose number the request hasn't got stays as it is. Stand-ins are undone longest first.
    """
    plain = replies.select("request", "line_no", "text")
    said = plain.where(F.contains("text", F.lit("<email-"))).select("request", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))).alias("at", "n"))
    said = said.withColumn("number", F.col("n").cast("long"))
    known = said.join(tokens, ["request", "number"], "left")
    back = F.struct("at", F.coalesce("email", F.concat(F.lit("<email-"), F.col("n"), F.lit(">"))).alias("email"))
    marks = known.groupBy("request", "line_no").agg(F.transform(F.array_sort(F.collect_list(back)), lambda t: t["email"]).alias("marks"))
    held = plain.join(marks, ["request", "line_no"], "left")
    out = F.when(F.col("marks").isNotNull(), _interleaved(F.col("text"), TOKEN, F.col("marks"))).otherwise(F.col("text"))
    undo = lambda pairs: sorted(((fake, real) for real, fake in pairs), key=lambda p: -len(p[0]))
    return held.select("request", "line_no", _swapped(out, undo(domains), undo(prefixes)).alias("text"))
