"""Many known rules at once: an index of the texts that rules require leaves each line a few of them.

From each pattern the literals are read of which every match holds one. An automaton finds all literals
of all rules in one pass over a line; the rules they belong to, and those without literals, are its
candidates, and only their patterns are tried, in the order of rules, by the same expressions that short
lists use. So rows are those of trying every rule, and a line's cost hardly grows with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser as P
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lines import bind, field, glob_regex, java_regex, program_of

#: Shortest literal that is worth an entry, and characters of all patterns together: they go to every worker.
SHORTEST, LARGEST = 3, 32 << 20
_LOW = str.maketrans(ascii_uppercase, ascii_lowercase)
_REPEATS = {C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT}


def _best(parsed) -> list[str] | None:
    """Literals, in lower case, of which a match of a parsed pattern holds one at least; None if there are none of SHORTEST."""
    found: list[list[str]] = []
    run = ""
    for op, value in parsed:
        inner = None
        if op is C.LITERAL:
            run += chr(value)
            continue
        if op is C.SUBPATTERN:
            if all(o is C.LITERAL for o, _ in value[3]):
                run += "".join(chr(v) for _, v in value[3])
                continue
            inner = _best(value[3])
        elif op in _REPEATS and value[0] > 0:
            inner = _best(value[2])
        elif op is C.BRANCH:
            each = [_best(b) for b in value[1]]
            inner = [x for b in each for x in b] if all(each) else None
        found += [[run]] if run else []
        found += [inner] if inner else []
        run = ""
    found += [[run]] if run else []
    good = [f for f in found if min(map(len, f)) >= SHORTEST]
    return [x.translate(_LOW) for x in max(good, key=lambda f: (min(map(len, f)), -len(f)))] if good else None


def required_literals(pattern: str) -> list[str] | None:
    """Literals, in lower case, of which every text that the pattern matches holds one; None where none are known.

    A pattern that Python reads otherwise than rules mean it, or not at all, has none and is always tried.
    """
    if "\\Q" in pattern or "[:" in pattern or "&&" in pattern or "(?x" in pattern:
        return None
    try:
        return _best(P.parse(pattern))
    except Exception:
        return None


def glob_literal(glob: str) -> list[str] | None:
    """The longest piece of a glob that stands for itself."""
    if "[" in glob or "\\" in glob:
        return None
    longest = max(glob.replace("?", "*").split("*"), key=len)
    return [longest.translate(_LOW)] if len(longest) >= SHORTEST else None


@lru_cache(maxsize=4)
def _automaton(digest: str, literals: tuple[tuple[str, ...], ...]):
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, own in enumerate(literals):
        for literal in own:
            places.setdefault(literal, []).append(k)
    found = ahocorasick.Automaton()
    for literal, rules in places.items():
        found.add_word(literal, rules)
    found.make_automaton()
    return found, len(places)


def candidates(text: Column, literals: list[list[str] | None], shown: list[tuple], schema: T.StructType) -> Column:
    """An array of the ``shown`` rows whose literals ``text`` may hold, in their order."""
    if sum(len(str(row)) for row in shown) > LARGEST:
        raise ValueError(f"rules of more than {LARGEST} characters together")
    always = [k for k, own in enumerate(literals) if own is None]
    keyed = tuple(tuple(own or ()) for own in literals)
    digest = hashlib.sha256(repr(keyed).encode()).hexdigest()

    @F.pandas_udf(T.ArrayType(schema))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, n = _automaton(digest, keyed)
        names = schema.fieldNames()
        rows = [dict(zip(names, row)) for row in shown]
        for texts in batches:
            out = []
            for t in texts:
                held = set(always)
                if n and t:
                    for _, rules in automaton.iter(t.translate(_LOW)):
                        held.update(rules)
                out.append([rows[k] for k in sorted(held)])
            yield pd.Series(out, dtype=object)

    return found(text)


_RULE = T.StructType([T.StructField("id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("program", T.StringType()), T.StructField("match", T.StringType()), T.StructField("expires", T.DateType())])


def with_rule(lines: DataFrame, rules: list, raw: str = "raw", day: Column | None = None) -> DataFrame:
    """``filtering.with_rule`` for any number of rules."""
    rules = sorted(rules, key=lambda r: r.id)
    literals, shown = [], []
    for r in rules:
        known = [x for x in (required_literals(r.match) if r.match else glob_literal(r.program), glob_literal(r.host)) if x]
        literals.append(max(known, key=lambda x: (min(map(len, x)), -len(x))) if known else None)
        shown.append((r.id, None if r.host == "*" else glob_regex(r.host), glob_regex(r.program), "(?md)" + java_regex(r.match) if r.match else None, r.expires))
    lines = bind(lines, _host=field(F.col(raw), 4), _rest=F.nullif(field(F.col(raw), 5), F.lit("")))
    lines = bind(lines, _program=program_of(F.col("_rest")))
    # a line of fewer than five fields fits no rule
    lines = lines.withColumn("_may", candidates(F.when(F.col("_rest").isNotNull(), F.concat_ws(" ", "_host", "_rest")), literals, shown, _RULE))
    host, program, rest = F.col("_host"), F.col("_program"), F.col("_rest")

    def fits(r: Column) -> Column:
        here = F.when(r["host"].isNull(), ~F.contains(host, F.lit("/"))).otherwise(F.regexp_like(host, r["host"]))
        said = F.when(r["match"].isNotNull(), F.regexp_like(rest, r["match"])).otherwise((program != "") & F.regexp_like(program, r["program"]))
        now = F.lit(True) if day is None else r["expires"].isNull() | (day <= r["expires"])
        return here & said & now

    first = F.get(F.filter("_may", fits), F.lit(0))["id"]
    return bind(lines, rule_id=F.when(rest.isNotNull(), first)).drop("_host", "_rest", "_program", "_may")


_ENTRY = T.StructType([T.StructField("match", T.StringType()), T.StructField("said", T.StringType())])


def said_of(lines: DataFrame, table: list[tuple[str, str]], raw: str = "raw") -> DataFrame:
    """``lines`` with ``_said``, the text of the first pattern of ``table`` that matches; null if none does."""
    shown = [("(?md)" + java_regex(p), text) for p, text in table]
    held = lines.withColumn("_may", candidates(F.col(raw), [required_literals(p) for p, _ in table], shown, _ENTRY))
    first = F.get(F.filter("_may", lambda r: F.regexp_like(F.col(raw), r["match"])), F.lit(0))["said"]
    return bind(held, _said=first).drop("_may")
