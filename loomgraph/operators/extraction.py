"""From turns to chunks, entities and relations: one pass over each row, without a shuffle.

Arrays that later steps refer to more than once are columns of their own, so that Spark computes each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.dictionary import keyed, phrases_in
from loomgraph.vocabulary import Chunking, Vocabulary

FAR = 1_000_000  # the place of a name that the text does not hold


def with_chunks(turns: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """``turns`` with chunk_profile, chunk_size, chunk_overlap and ``chunks``, windows of words. A text of one window stays
    as it is, but for white space at its ends; a blank one is a single empty chunk."""
    body = turns.withColumn("_body", X.strip(F.col("text")))
    by_text = F.when(X.is_structured(F.col("_body"), chunking), F.lit("structured")).otherwise(F.lit("default"))
    profile = by_text if chunking.profile == "auto" else F.lit(chunking.profile)
    size = lambda i: F.when(F.col("chunk_profile") == "structured", F.lit(chunking.sized(True)[i])).otherwise(F.lit(chunking.sized(False)[i]))
    sized = body.withColumn("chunk_profile", F.when(F.col("_body") == "", F.lit("default")).otherwise(profile))
    sized = sized.withColumns({"chunk_size": size(0), "chunk_overlap": size(1), "_words": F.regexp_extract_all("_body", F.lit(r"(?U)\S+"), F.lit(0))})
    step = F.greatest(F.lit(1), F.col("chunk_size") - F.col("chunk_overlap"))
    last = F.ceil((F.size("_words") - F.col("chunk_size")) / step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda i: F.array_join(F.slice("_words", i * step + 1, F.col("chunk_size")), " "))
    return sized.withColumn("chunks", F.when(F.size("_words") <= F.col("chunk_size"), F.array("_body")).otherwise(windows)).drop("_body", "_words")


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """(turn_uid, chunk_no, chunk_text, chunk_profile, chunk_size, chunk_overlap), chunks numbered from 0."""
    # Outer: the array is never empty, and a condition on it would have it computed a second time.
    return chunked.select("turn_uid", "chunk_profile", "chunk_size", "chunk_overlap", F.posexplode_outer("chunks").alias("chunk_no", "chunk_text"))


def _found(surfaces: Column, confidence: float, always: bool = False) -> Column:
    return F.transform(surfaces, lambda s: F.struct(s.alias("surface"), F.lit(confidence).alias("confidence"), F.lit(always).alias("always")))


def _windows(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens (one shorter run, if there are not as many)."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - n)), lambda i: F.slice(tokens, i + 1, n))


def with_entities(turns: DataFrame, vocabulary: Vocabulary = Vocabulary(), text: str = "text") -> DataFrame:
    """``turns`` with ``entities``: struct<canonical_name, surface, entity_type, confidence>, the surest first, then by name.

    Four finders, of which the first that knows a name decides: phrases of the vocabulary, quoted terms, n-grams around a
    keyword, words in capitals."""
    v = vocabulary
    low = turns.withColumn("_low", F.lower(text))
    low = low.withColumn("_tokens", F.regexp_extract_all("_low", F.lit(r"[a-z0-9가-힣][a-z0-9가-힣\-+/]*"), F.lit(0)))
    none = F.array().cast("array<string>")
    # Of several phrases that mean the same, the last of the vocabulary counts.
    if v.large:
        low = low.withColumns({"_phrases": phrases_in(F.col("_low"), v.phrases), "_keyed": keyed(F.col("_tokens"), v.keywords)})
        phrases = F.col("_phrases")
    else:
        phrases = F.filter(F.array(*[F.lit(p) for p in reversed(v.phrases)]), lambda p: F.contains(F.col("_low"), p)) if v.phrases else none
    quoted = F.concat(*[F.regexp_extract_all(text, F.lit(f"{q}([^{q}]{{2,80}}){q}"), F.lit(1)) for q in ("`", '"', "'")])
    keywords = F.array(*[F.lit(k) for k in v.keywords]) if v.keywords and not v.large else none
    grams = []
    for n in range(1, v.max_ngram + 1):
        windows = _windows(F.col("_tokens"), n)
        if v.large:
            near = F.filter(windows, lambda w, i: F.array_contains(F.slice("_keyed", i + 1, n), True))  # noqa: B023
        else:
            near = F.filter(windows, lambda w: F.arrays_overlap(w, keywords))
        joined = F.filter(F.transform(near, lambda w: F.array_join(w, " ")), lambda g: F.char_length(g) >= v.min_length)
        grams.append(F.when(F.size("_tokens") >= n, joined).otherwise(none))
    capitals = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z]{2,}\b"), F.lit(0))
    # Each surface once is enough, and cheaper: what decides is the first place of a name.
    every = F.concat(_found(phrases, 0.90, True), _found(F.array_distinct(quoted), 0.82), _found(F.array_distinct(F.concat(none, *grams)), 0.72), _found(F.array_distinct(capitals), 0.75))
    named = F.transform(every, lambda c: F.struct(X.normalize_surface(c.surface).alias("normal"), c.alias("c")))
    if v.large:
        low = low.withColumn("_named", named)
        low = low.withColumn("_names", X.canonical_all(F.transform("_named", lambda e: e.normal), v))
        placed = F.transform("_named", lambda e, i: F.struct(F.get("_names", i).alias("name"), i.alias("place"), e.c.alias("c")))
    else:
        placed = F.transform(named, lambda e, i: F.struct(X.canonical_of(e.normal, v).alias("name"), i.alias("place"), e.c.alias("c")))
    kept = F.filter(placed, lambda e: e.c.always | (F.char_length(e["name"]) >= v.min_length))
    low = low.withColumn("_sorted", F.array_sort(kept))
    first = F.filter("_sorted", lambda e, i: (i == 0) | (F.get("_sorted", i - 1)["name"] != e["name"]))
    ranked = F.array_sort(F.transform(first, lambda e: F.struct((-e.c.confidence).alias("minus"), e["name"].alias("name"), e.c.surface.alias("surface"))))
    entities = F.transform(ranked, lambda e: F.struct(e["name"].alias("canonical_name"), e.surface.alias("surface"), X.entity_type(e["name"], v).alias("entity_type"), (-e.minus).alias("confidence")))
    return low.withColumn("entities", F.coalesce(entities, F.array().cast("array<struct<canonical_name:string,surface:string,entity_type:string,confidence:double>>"))).drop("_low", "_tokens", "_sorted", "_phrases", "_keyed", "_named", "_names")


def with_relations(turns: DataFrame, vocabulary: Vocabulary = Vocabulary(), text: str = "text") -> DataFrame:
    """``turns`` (with entities) with ``relations``: struct<source, target, relation_type, confidence>. The entities in the order
    in which the text names them are a chain, each linked with the next; the kind of link is the text's."""
    at = lambda name: F.instr(F.col("_low"), name)
    low = turns.withColumns({"_low": F.lower(text), "_type": X.relation_type(F.col(text), vocabulary)})
    placed = F.transform("entities", lambda e, i: F.struct(F.when(at(e.canonical_name) > 0, at(e.canonical_name) - 1).otherwise(F.lit(FAR)).alias("at"), i.alias("place"), e.canonical_name.alias("name")))
    low = low.withColumn("_chain", F.array_sort(placed))
    sure = F.when(F.col("_type") == "RELATED_TO", F.lit(0.62)).otherwise(F.lit(0.78))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_chain") - 1), lambda i: F.struct(F.get("_chain", i - 1)["name"].alias("source"), F.get("_chain", i)["name"].alias("target"), F.col("_type").alias("relation_type"), sure.alias("confidence")))
    none = F.array().cast("array<struct<source:string,target:string,relation_type:string,confidence:double>>")
    links = F.filter(F.when(F.size("_chain") >= 2, pairs).otherwise(none), lambda r: r.source != r.target)
    return low.withColumn("relations", links).drop("_low", "_type", "_chain")
