"""Operator 3: host-level quality rules.

Every document is measured by rules; failures are counted by host, each host's failure rate is shrunk towards the
corpus by a beta prior that is fitted to the hosts themselves, and the hosts' verdicts are joined back. A host's verdict is
a tolerance, 1 less its shrunk failure rate: a document may use up that share of each rule's limit, so what passes in a
good host goes in a bad one. Never less than ``least`` of a limit is granted, so a document that is far from all limits
stays wherever it comes from.

Null or empty text: no words, which fails the length rule. A null host is a host of its own. Repeated rows are judged
one by one. Hosts of any size are summed in parts before they are shuffled. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textscan as ts
from sparkloom.llm.durable import written

SYMBOLS = ts.byte_table("#*$%&|<>")
CAPITALS = ts.byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
NEWLINE = ts.byte_table("\n")
REPEAT_WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The values of MEASURES for each row of a slice."""
    n = len(offsets) - 1
    inside = ts.SPACED[data]
    starts, ends, rows = ts.runs(inside, offsets)
    hasher = ts.Hasher(data)
    n_words = np.bincount(rows, minlength=n)
    heads = (data & 0xC0) != 0x80
    first, values = ts.windows(hasher(starts, ends), rows, REPEAT_WINDOW)
    repeated = _repeats(rows[first], values)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[repeated], 1)
    np.add.at(cover, first[repeated] + REPEAT_WINDOW, -1)
    covered = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)
    line_starts, line_ends, line_rows = ts.runs(~NEWLINE[data], offsets)
    words_before = np.concatenate([[0], np.cumsum(inside)])
    full = words_before[line_ends] > words_before[line_starts]
    line_rows = line_rows[full]
    again = _repeats(line_rows, hasher(line_starts[full], line_ends[full]), later=True)
    return [
        n_words,
        ts.per_row(inside & heads, offsets),
        ts.per_row(SYMBOLS[data], offsets),
        np.bincount(line_rows[again], minlength=n),
        covered,
        np.bincount(line_rows, minlength=n),
        ts.per_row(CAPITALS[data], offsets),
    ]


def _repeats(rows: np.ndarray, values: np.ndarray, later: bool = False) -> np.ndarray:
    """Places whose value occurs twice or more in their row (``later``: occurred before in it)."""
    key = ts.mix(values ^ (rows.astype(ts.U) * ts.U(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    flags = np.zeros(len(key), bool)
    flags[order[1:][same]] = True
    if not later:
        flags[order[:-1][same]] = True
    return np.flatnonzero(flags)


def measured(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with a column for each of MEASURES (columns of these names are replaced)."""
    base = docs.drop(*[m for m in MEASURES if m != text_col])
    kept = [f for f in base.schema if keep_text or f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{m} long" for m in MEASURES])
    at, places = base.columns.index(text_col), [base.columns.index(f.name) for f in kept]

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in ts.slices(batch.column(at)):
                part = batch.slice(start, end - start)
                values = [pa.array(v, pa.int64()) for v in measure_slice(data, offsets)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + values, [f.name for f in kept] + list(MEASURES))

    return base.mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def misshapen() -> Column:
    """Words of over 12 or under 2 characters on average."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return (chars > 12 * words) | (chars < 2 * words)


def burden() -> Column:
    """The largest share of a limit that a document uses: symbols (a tenth of the words), repeated lines (0.4 of the lines),
    capitals (0.4 of the characters), words in repeated windows (0.3 of the words)."""
    words, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return F.greatest(10.0 * F.col("n_symbols") / words, 2.5 * F.col("n_dup_lines") / lines, 2.5 * F.col("n_capitals") / chars, 10.0 * F.col("n_repeat_words") / (3.0 * words))


def host_verdicts(rows: DataFrame, host_col: str = "source", least: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, tolerance.

    The prior's mean is the mean rate of the hosts; its strength follows from the variance between hosts beyond that
    of sampling (moments), held between 1 and 10,000 documents.
    """
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum((base_failed() | misshapen() | (burden() > 1)).cast("long")).alias("host_failures")
    )
    hosts = written(hosts, "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_docs")).alias("inverse"))
    spread = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") - spread * F.col("inverse"), F.lit(1e-9))
    prior = prior.select("m", F.least(F.greatest(spread / between - 1, F.lit(1.0)), F.lit(10_000.0)).alias("strength"))
    shrunk = (F.col("host_failures") + F.col("m") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    rates = hosts.join(F.broadcast(prior)).select("host", "host_docs", "host_failures", shrunk.alias("host_rate"))
    return rates.withColumn("tolerance", F.greatest(F.lit(least), 1 - F.col("host_rate")))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep_text: bool = True, least: float = 0.5) -> DataFrame:
    """The rows with MEASURES, base_failed, host_rate and kept (columns of these names are replaced).

    The measures are taken twice, once for the hosts and once for the result, which costs less than to move texts.
    """
    new = [*MEASURES, "base_failed", "host_rate", "kept"]
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    narrow = docs.select(F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    hosts = host_verdicts(measured(narrow, keep_text=False), least=least).select("host", "host_rate", "tolerance")
    rows = measured(docs.toDF(*names.values()), names[text_col], keep_text)
    judged = rows.join(hosts, rows[names[host_col]].eqNullSafe(hosts["host"]), "left").withColumn("base_failed", base_failed())
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~misshapen() & (burden() <= F.col("tolerance")))
    return judged.select(*[F.col(name).alias(c) for c, name in names.items() if c not in new and (keep_text or c != text_col)], *new)


def accepted(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that :func:`quality_rules` keeps, with the columns of ``docs``."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    places = [names[docs.columns.index(c)] for c in (text_col, host_col)]
    return quality_rules(docs.toDF(*names), *places).where("kept").select(names).toDF(*docs.columns)
