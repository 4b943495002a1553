"""Text functions as Column expressions. Regular expressions are Unicode-aware (``(?U)``), and white space is more than blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.dictionary import canonicals
from loomgraph.vocabulary import OTHER_RELATION, OTHER_TYPE, Chunking, Vocabulary

_WHITE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"(?U)^{_WHITE}+|{_WHITE}+\z", "")


def normalize_surface(text: Column) -> Column:
    """Lower case, quotes gone, everything but letters a-z, digits, Hangul and ``- _ / +`` a blank, blanks joined."""
    bare = F.regexp_replace(F.lower(text), "[`'\"“”’]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^a-z0-9가-힣\-\s_/+]", " "), rf"(?U){_WHITE}+", " "))


def canonical_of(normal: Column, vocabulary: Vocabulary) -> Column:
    """The synonym of a normalised name, of the name without blanks, or the name itself."""
    if not vocabulary.synonyms:
        return normal
    if vocabulary.large:
        return F.element_at(canonicals(F.array(normal), vocabulary.synonyms), 1)
    synonyms = F.create_map(*[F.lit(x) for pair in vocabulary.synonyms.items() for x in pair])
    return F.coalesce(F.element_at(synonyms, normal), F.element_at(synonyms, F.replace(normal, F.lit(" "), F.lit(""))), normal)


def canonical_all(normals: Column, vocabulary: Vocabulary) -> Column:
    """``canonical_of`` each of an array. A large vocabulary's may stand in no function that is applied to elements."""
    if vocabulary.large and vocabulary.synonyms:
        return canonicals(normals, vocabulary.synonyms)
    return F.transform(normals, lambda n: canonical_of(n, vocabulary))


def canonicalize(text: Column, vocabulary: Vocabulary) -> Column:
    return canonical_of(normalize_surface(text), vocabulary)


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("ent:"), F.substring(F.sha1(name.cast("binary")), 1, 16))


def _first_marked(text: Column, rules, other: str) -> Column:
    found = None
    for name, markers in rules:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(text, F.lit(marker))
        found = F.when(hit, F.lit(name)) if found is None else found.when(hit, F.lit(name))
    return found.otherwise(F.lit(other)) if found is not None else F.lit(other)


def entity_type(name: Column, vocabulary: Vocabulary) -> Column:
    return _first_marked(name, vocabulary.type_markers, OTHER_TYPE)


def relation_type(text: Column, vocabulary: Vocabulary) -> Column:
    """The first kind of relation that any marker in the text stands for."""
    return _first_marked(F.lower(text), vocabulary.relation_markers, OTHER_RELATION)


def importance(text: Column, vocabulary: Vocabulary) -> Column:
    """Sum of the weights of the patterns found, each once, 1 at most."""
    total = F.lit(0.0)
    for pattern, weight in vocabulary.importance:
        total = total + F.when(F.rlike(text, F.lit(f"(?iu){pattern}")), F.lit(float(weight))).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.round(total, 6))


def is_structured(text: Column, chunking: Chunking) -> Column:
    """Whether enough of the non-blank lines look like headings or items of a list."""
    lines = F.filter(F.transform(F.split(text, "\\R|[\\x1c-\\x1e]"), strip), lambda x: x != "")
    item = r"(?U)^(?:[-*•]\s+|\d+[.)]\s+|#{1,6}\s+)"
    short = r"^[가-힣A-Za-z0-9 _/\-]{2,48}$"
    heading = F.filter(lines, lambda x: F.rlike(x, F.lit(item)) | ((F.char_length(x) <= 64) & F.endswith(x, F.lit(":"))) | F.rlike(x, F.lit(short)))
    return (F.size(lines) >= chunking.min_lines) & (F.size(heading) >= F.lit(chunking.heading_ratio) * F.size(lines))


def embedding_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z0-9가-힣_\-+/]+"), F.lit(0))


def search_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def recency(anchor: Column, now: Column, half_life_hours: Column | float) -> Column:
    """1 at the anchor, one half after each half-life; 1 always without one. ``now`` is given, never the clock."""
    half = half_life_hours if isinstance(half_life_hours, Column) else F.lit(float(half_life_hours))
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(anchor)) / F.lit(3.6e9))
    return F.when(half <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-F.lit(0.6931471805599453) * hours / half))))
