"""Many phrases looked for at once: an Aho-Corasick automaton over each text, built once in a worker.

The phrases are dealt out in parts whose size is checked; each part's automaton
goes to all tasks and each text is read once a part.  Only phrases that were
found leave a task.  Phrases of whole words that are too many for one automaton
are joined with the runs of words of the texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.scratch import written

#: Characters of the phrases that one automaton may hold: some 100 MB in a worker.
MOST_CHARS = 2_000_000
#: Words of the phrases that runs of words are made for; longer phrases are left to automata.
MOST_WORDS = 8


@functools.lru_cache(maxsize=2)
def automaton(phrases: tuple[str, ...], whole_words: bool):
    """Finds any of the phrases in a text; with ``whole_words`` only between blanks."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        made.add_word(f" {p} " if whole_words else p, k)
    made.make_automaton()
    return made


def found_in(text: str, phrases: tuple[str, ...], whole_words: bool = False) -> list[int]:
    """Numbers of the phrases that the text holds, each once, in order of the numbers."""
    made = automaton(phrases, whole_words)
    if not len(made):
        return []
    return sorted({k for _, k in made.iter(f" {text} " if whole_words else text)})


def parts(phrases: DataFrame, most_chars: int = MOST_CHARS) -> Iterator[tuple[str, ...]]:
    """The distinct phrases, dealt out by hash in as many parts as their characters ask for; a part is fetched when it is used."""
    listed = _listed(phrases)
    yield from _parts(listed, _size(listed), most_chars)


def _listed(phrases: DataFrame) -> DataFrame:
    phrase = F.col(phrases.columns[0])
    return written(phrases.select(phrase.alias("phrase")).where("phrase <> ''").distinct(), "phrases")


def _size(listed: DataFrame) -> int:
    return int(listed.agg(F.coalesce(F.sum(F.length("phrase") + 2), F.lit(0))).first()[0])


def _parts(listed: DataFrame, size: int, most_chars: int) -> Iterator[tuple[str, ...]]:
    n = -(-size // most_chars)
    for k in range(n):
        # Twice the mean is far beyond what a hash deals to one part; the check holds all the same.
        part = listed.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k) if n > 1 else listed
        got = tuple(sorted(part.toArrow()["phrase"].to_pylist()))
        if sum(map(len, got)) > 2 * most_chars + max(map(len, got), default=0):
            raise ValueError("the phrases do not deal out evenly")
        yield got


def _by_runs(rows: DataFrame, listed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Matches of whole words: a text's distinct runs of as many words as phrases have, joined with the phrases."""
    lengths = sorted(r[0] for r in listed.select(_words("phrase")).distinct().collect())
    of = lambda words: F.array_distinct(F.flatten(F.array(*[X.runs(words, n) for n in lengths])))
    made = rows.select(*keep, F.explode(X.let(F.split("__text", " ", -1), of)).alias("phrase"))
    return made.join(listed, "phrase", "left_semi").select(*keep, "phrase")


def _words(column: str) -> Column:
    return F.size(F.split(column, " ", -1))


def matches(texts: DataFrame, text: Column, phrases: DataFrame, keep: Sequence[str], whole_words: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """The columns ``keep`` and ``phrase`` for every phrase that a row's text holds, once a row.

    ``phrases`` has them in its first column; empty ones and nulls match nothing,
    as do null texts.  With ``whole_words`` both sides are words parted by one
    blank, and phrases match between blanks only.

    Phrases beyond one automaton would have each text read once a part.  Those of
    whole words, of MOST_WORDS at most, are joined instead with the runs of words
    of the texts, which are read once however many phrases there are.
    """
    spark = texts.sparkSession
    rows = texts.select(*keep, text.alias("__text")).where("__text IS NOT NULL")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    out, listed = None, _listed(phrases)
    size = _size(listed)
    if whole_words and size > most_chars:
        short = listed.where(_words("phrase") <= MOST_WORDS)
        out, listed = _by_runs(rows, short, keep), listed.where(_words("phrase") > MOST_WORDS)
        size = _size(listed)
    for got in _parts(listed, size, most_chars):
        numbered = spark.sparkContext.broadcast(got)

        def run(frames: Iterator[pd.DataFrame], numbered=numbered) -> Iterator[pd.DataFrame]:
            for frame in frames:
                hits = [found_in(t, numbered.value, whole_words) for t in frame["__text"]]
                made = frame.drop(columns="__text").loc[frame.index.repeat([len(h) for h in hits])]
                yield made.assign(phrase=pd.Series([numbered.value[k] for h in hits for k in h], index=made.index, dtype=object))

        part = rows.mapInPandas(run, f"{kind}, phrase string")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(*keep, F.lit(None).cast("string").alias("phrase")).where("false")
