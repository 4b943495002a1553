"""Vocabularies of thousands of entries, looked up in Arrow batches: phrases by one automaton, keywords and synonyms by hash
tables. As literals of a plan each row would be compared with every entry. Each task builds its automaton once; the entries go
to the workers with the function. Results are those of the plain expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def phrases_in(low: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that a text contains anywhere, the last of the vocabulary first; an empty phrase is in every text, a null
    text has none. One pass over a text, however many phrases there are."""
    entries = list(phrases)

    @F.pandas_udf("array<string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton, always = ahocorasick.Automaton(), []
        for k, phrase in enumerate(entries):
            if phrase == "":
                always.append(k)
            else:
                automaton.add_word(phrase, (*automaton.get(phrase, ()), k))
        automaton.make_automaton()

        def of(text: str | None) -> list[str]:
            if text is None:
                return []
            hits = {k for _, ks in automaton.iter(text) for k in ks} if len(automaton) else set()
            return [entries[k] for k in sorted(hits.union(always), reverse=True)]

        for batch in texts:
            yield batch.map(of)

    return find(low)


def keyed(tokens: Column, keywords: tuple[str, ...]) -> Column:
    """For each token whether it is a keyword."""
    known = frozenset(keywords)

    @F.pandas_udf("array<boolean>")
    def find(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: None if ts is None else [t in known for t in ts])

    return find(tokens)


def canonicals(normals: Column, synonyms: dict[str, str]) -> Column:
    """For each of an array of normalised names its synonym, that of the name without blanks, or the name itself."""
    known = dict(synonyms)

    @F.pandas_udf("array<string>")
    def find(rows: pd.Series) -> pd.Series:
        of = lambda n: None if n is None else known.get(n, known.get(n.replace(" ", ""), n))
        return rows.map(lambda ns: None if ns is None else [of(n) for n in ns])

    return find(normals)
