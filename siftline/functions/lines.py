"""Syslog lines as columns: splitting, parsing, keys, masks and templates.

A line is ``Mon DD HH:MM:SS host program[pid]: message``. Everything is built-in column
functions, so it stays in generated code on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it.
WS = r"[\s\x0B\u0085   -     　]"
#: All other characters; those of ASCII, of which most text is, are told first.
NS = f"[!-~{WS.replace('[', '[^', 1)}]"
#: All other characters but an opening bracket.
TAG = r"[!-Z\\-~" + WS.replace("[", "[^", 1)[:-1] + r"\[]]"
#: A word boundary that knows ASCII words only.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_W = "[0-9A-Za-z_-]"
#: What masks replace, in this order (fixed values). Each begins with what is cheap to tell and rare, as it is tried
#: at every place of a text; a name before an @ is tried once, from its first character or where the last address ended.
EMAIL = r"(?:\G|(?<![0-9A-Za-z_.+%-]))[0-9A-Za-z_.+%-]++@[0-9A-Za-z_-]+(?:\.[0-9A-Za-z_-]+)+"
IPV4 = rf"(?=[0-9]{{1,3}}\.){EDGE}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{EDGE}"
_H = "[0-9a-fA-F]{1,4}"
IPV6 = rf"(?=[0-9a-fA-F]{{0,4}}+:)(?:{EDGE}(?:{_H}:){{5,7}}{_H}{EDGE}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)"
FQDN = rf"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?=-)(?<=[0-9A-Za-z_]))(?=(?:[0-9_-]|\.(?={_W}))*+[A-Za-z]){_W}++(?:\.{_W}+){{2,}}{EDGE}"
HEX = rf"(?=[0-9a-fA-F-]{{16}}){EDGE}[0-9a-fA-F-]{{16,}}{EDGE}"
USER = rf"(?i)(?=user[= ]){EDGE}(user[= ])([^\t\n\f\r ]+)"
FOR_USER = rf"(?=for ){EDGE}for (invalid user )?([^\t\n\f\r ]+) from{EDGE}"

#: A number outside of tokens, and all that is between it and the last one.
NUMBER = r"\G((?:[^<0-9]++|<[a-z0-9]+>|<)*+)[0-9]+"


#: Four words and the rest of a line from its fifth word on; nothing is tried twice.
LINE = rf"(?s)^{WS}*+({NS}++){WS}++({NS}++){WS}++({NS}++){WS}++({NS}++){WS}++({NS}.*)"


def field(line: Column, k: int) -> Column:
    """The k-th of a line's first four words, or (5) the rest as it stands; empty if there are fewer than five.

    ``split`` would build its pattern anew for every row; extraction builds it once a task.
    """
    return F.regexp_extract(line, LINE, k)


def bind(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with the columns set, each worked out once a row, however often it is used above.

    The optimiser copies an expression into every filter and column that uses it; it does not
    merge through a generator, so the values come out of one that gives one row a row.
    """
    drop = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in drop]
    return rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))


def parse(lines: DataFrame, raw: str = "raw", minutes: int = 10) -> DataFrame:
    """``lines`` with stamp, host, program, bucket (``HH:MM`` of ``minutes``), rest; null where a line doesn't fit."""
    lines = bind(lines, _stamp=field(F.col(raw), 3), _host=field(F.col(raw), 4), _rest=field(F.col(raw), 5))
    lines = bind(lines, _program=program_of(F.col("_rest")))
    stamp, program = F.col("_stamp"), F.col("_program")
    minute = F.substring(stamp, 4, 2)
    fits = (F.length(stamp) >= 5) & (F.substring(stamp, 3, 1) == ":") & minute.rlike("^([0-9]{2}|[+-][0-9])$") & (program != "")
    low = F.floor(F.regexp_replace(minute, "[+-]", "").try_cast("int") / minutes) * minutes
    bucket = F.concat(F.substring(stamp, 1, 2), F.lit(":"), F.lpad(low.cast("string"), 2, "0"))
    found = {"stamp": stamp, "host": F.col("_host"), "program": program, "bucket": bucket, "rest": F.col("_rest")}
    return bind(lines, **{c: F.when(fits, v) for c, v in found.items()}).drop("_stamp", "_host", "_rest", "_program")


def program_of(rest: Column) -> Column:
    """The program that the text after the host begins with, without pid and colons."""
    return F.rtrim(F.regexp_extract(rest, f"^({TAG}*)", 1), F.lit(":"))


def strip_pids(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[0-9]+\]", "")


def with_key(lines: DataFrame, raw: Column | None = None) -> DataFrame:
    """``lines`` with ``_key`` and ``_host``: the text after the host without pids, and the host.

    Lines of fewer than five fields have their trimmed text as key and no host.
    """
    raw = F.col("raw") if raw is None else raw
    lines = bind(lines, _rest=field(raw, 5), _host=F.nullif(field(raw, 4), F.lit("")))
    trimmed = F.regexp_replace(raw, f"^{WS}+|{WS}+$", "")
    return bind(lines, _key=strip_pids(F.when(F.col("_rest") != "", F.col("_rest")).otherwise(trimmed))).drop("_rest")


def _where(text: Column, holds, pattern: str | Column, token: str) -> Column:
    """``text`` with the pattern replaced where the cheap test ``holds``; the array of one binds the text."""
    made = lambda x: F.regexp_replace(x, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(token))
    return F.transform(F.array(text), lambda x: F.when(holds(x), made(x)).otherwise(x))[0]


def mask(message: Column, host: Column) -> Column:
    """The message with what varies between repeats replaced by tokens."""
    m = _where(message, lambda x: x.contains("@"), EMAIL, "<email>")
    m = F.when(F.coalesce(host, F.lit("")) != "", F.replace(m, host, F.lit("<host>"))).otherwise(m)
    short = F.substring_index(host, ".", 1)
    literal = F.concat(F.lit(r"\Q"), F.replace(short, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    quoted = F.concat(F.lit("(?="), literal, F.lit(")" + EDGE), literal, F.lit(EDGE))
    m = _where(m, lambda x: F.coalesce((F.length(short) > 2) & x.contains(short), F.lit(False)), quoted, "<host>")
    m = _where(m, lambda x: x.contains("."), IPV4, "<ip>")
    m = _where(m, lambda x: x.contains(":"), IPV6, "<ip6>")
    m = _where(m, lambda x: x.rlike(rf"\.{_W}+\.{_W}"), FQDN, "<fqdn>")
    m = F.regexp_replace(m, HEX, "<hex>")
    m = F.regexp_replace(m, USER, "$1<user>")
    m = _where(m, lambda x: x.contains("for "), FOR_USER, "for $1<user> from")
    return F.regexp_replace(m, NUMBER, "$1<n>")


def templates(parsed: DataFrame) -> DataFrame:
    """Parsed lines with ``template``: the message after the program's tag, masked; null if not parsed."""
    at = F.instr("rest", " ")
    message = F.when(at > 0, F.substring(F.col("rest"), at + 1, F.length("rest"))).otherwise("")
    return bind(parsed, template=F.when(F.col("program").isNotNull(), mask(message, F.col("host"))))


def untag(line: Column) -> Column:
    """A line without the tags of ``collapse`` and ``tag_spread``."""
    return F.regexp_replace(F.trim(line), r"^(\[(x[0-9]+ [^\]]*|on [0-9]+ hosts)\] )+", "")


def glob_regex(glob: str) -> str:
    """An anchored regex for a glob; ``*`` and ``?`` never cross ``/``; a bad glob matches nothing."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if at == len(glob):
                return "(?!)"
            out.append(r"\Q" + glob[at] + r"\E")
            at += 1
        elif c == "[":
            end = glob.find("]", at + 1 + (glob[at : at + 1] == "^"))
            if end < 0:
                return "(?!)"
            body = glob[at:end]
            neg, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * neg + body.replace("[", r"\[").replace("&&", r"\&\&") + "]")
            at = end + 1
        else:
            out.append(r"\Q" + c + r"\E")
    return "^" + "".join(out) + r"\z"


def severity_rank(severity: Column) -> Column:
    """critical 0, high 1, medium 2, low 3, anything else 99."""
    low = F.lower(severity)
    return F.when(low == "critical", 0).when(low == "high", 1).when(low == "medium", 2).when(low == "low", 3).otherwise(99)


def thousands(n: Column) -> Column:
    """A whole number with commas; halves go to the even neighbour."""
    return F.format_number(n, 0)


def hosts_summary(hosts: Column, most: int = 5) -> Column:
    """The first hosts, and how many more there are."""
    first = F.array_join(F.slice(hosts, 1, most), ", ")
    return F.when(F.size(hosts) > most, F.concat(first, F.lit(" and "), (F.size(hosts) - most).cast("string"), F.lit(" more"))).otherwise(first)


def os_family(programs: Column, windows: list[str], unix: list[str]) -> Column:
    """A guess at a host's system from its programs: hints of both kinds, or none, are unknown."""
    has = lambda hints: F.exists(programs, lambda p: F.lower(p).rlike("|".join(r"\Q" + h + r"\E" for h in hints)))
    a, b = has(windows), has(unix)
    return F.when(a & ~b, "windows").when(b & ~a, "unix").otherwise("unknown")


#: POSIX class names, which Java has under other names.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
#: Escapes that Java reads otherwise: white space without the vertical tab, all else, the vertical tab alone.
SPACES = {"s": r"\t\n\f\r ", "S": r"^\t\n\f\r ", "v": r"\x0B"}
_TOKEN = re.compile(r"\\Q.*?(?:\\E|$)|\\[pP]\{\^?\w+\}|\\x\{[0-9A-Fa-f]+\}|\\.|\[\^?\]?|\(\?P<|\(\?<?[=!]|\(\?>|&&|.", re.S)


def java_regex(pattern: str) -> str:
    """A rule's pattern, written for linear-time engines, as one that Java reads alike.

    Named groups and POSIX classes are respelt, ``\\s`` and ``\\v`` mean what they mean there, and
    inside brackets ``[`` and ``&&`` stand for themselves. Back references and looking around,
    which those engines don't have, raise ``ValueError``.
    """
    out, inside, at = [], False, 0
    while at < len(pattern):
        if inside and (named := re.match(r"\[:(\^?)(\w+):\]", pattern[at:])):
            if named[2] not in POSIX:
                raise ValueError(f"no such class: {named[0]}")
            out.append(f"[^{POSIX[named[2]]}]" if named[1] else POSIX[named[2]])
            at += len(named[0])
            continue
        token = _TOKEN.match(pattern, at)[0]
        if inside and token[0] in "[(":  # neither opens anything there
            token = token[0]
        at += len(token)
        if token.startswith("\\"):
            name = token[1:]
            if name in SPACES:
                out.append(SPACES[name] if inside and name != "S" else f"[{SPACES[name]}]")
            elif name[:1].isdigit() and name[:1] != "0" or name[:1] in "kGZRXhHNV":
                raise ValueError(f"{token} is not supported in rules")
            else:
                out.append(token)
        elif inside:
            inside = token != "]"
            out.append("\\" + token if token == "[" else "&\\&" if token == "&&" else token)
        elif token[0] == "[":
            inside = True
            out.append(token[:-1] + "\\]" if token.endswith("]") else token)
        elif token == "(?P<":
            out.append("(?<")
        elif re.match(r"\(\?<?[=!>]", token):
            raise ValueError(f"{token} is not supported in rules")
        else:
            out.append(token)
    return "".join(out)


#: What stands for a secret, and what one looks like: a value after a telling name, credentials of a URL or a header, keys known by their form.
MASK = "****"
SECRETS = [
    (r"(?i)((?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*)(?:\"[^\"]*\"|'[^']*'|[^\s,;&\"']+)", "$1"),
    (r"(?i)\b((?:bearer|basic)\s+)[a-z0-9+/=._~-]{8,}", "$1"),
    (r"(?i)(\b[a-z][a-z0-9+.-]*://[^\s:/@]*:)[^\s/@]+(?=@)", "$1"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[opsu]_[0-9A-Za-z]{36}\b|\beyJ[\w-]+\.[\w-]+\.[\w-]*", ""),
]


def mask_secrets(text: Column) -> Column:
    """``text`` for display: what looks like a password, key or token is ``****``, the words around it stay. Null stays null."""
    for pattern, kept in SECRETS:
        text = F.regexp_replace(text, pattern, kept + MASK.replace("$", r"\$"))
    return text
