"""Mentions merged into one entity or relation, and their descriptions summarised.

A name may hold a large part of all mentions.  Counts and sums have partial
states; source ids are made distinct before they are counted, and come out as lists
in segments (:func:`entity_sources`, :func:`relation_sources`).  Descriptions are
only ever gathered in blocks of ``BLOCK``, in their order: a key of more is numbered
by exact offset chunking, so no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import jsontext, providers
from quern.functions import text as T
from quern.operators import hotkeys
from quern.operators.chunking import pack_greedily
from quern.sources.tables import materialise

#: Below so many descriptions, and below so many tokens, they are joined as they are.
COUNT, BUDGET, CONTEXT, DEPTH, BLOCK = 6, 500, 2000, 3, 1000

SUMMARY_PROMPT = (
    "Below are descriptions of one {kind}, named {name}, as JSON lines.\n"
    "Write one description of it in {language}, in the third person, of at most {budget} tokens, that keeps every fact and names it in full. "
    "Where descriptions contradict each other, say so.\n\n{lines}\n"
)


def summary_prompt(name: Column, texts: Column, kind: str = "entity", budget: int = BUDGET, language: str = "English") -> Column:
    """The request for one summary of an array of descriptions."""
    return jsontext.fill(SUMMARY_PROMPT, kind=F.lit(kind), name=F.coalesce(name, F.lit("(unnamed)")), language=F.lit(language), budget=F.lit(budget), lines=jsontext.json_lines(texts))


@dataclass(frozen=True)
class FrameReduce:
    """A reducer that works on a table: ``key, place, texts`` to ``key, place, text``."""

    run: Callable[[DataFrame, str], DataFrame]


#: Turns an array of texts into one: an expression, or a :class:`FrameReduce`.
Reduce = Callable[[Column], Column] | FrameReduce


def by_provider(endpoint: providers.Endpoint, kind: str = "entity", budget: int = BUDGET, language: str = "English") -> FrameReduce:
    """Summaries by a chat endpoint; a call that fails for good fails the job."""
    def run(df: DataFrame, key: str) -> DataFrame:
        asked = df.select(F.to_json(F.struct(F.col(key).alias("k"), "place")).alias("id"), F.lit("").alias("system"), summary_prompt(F.col(key), F.col("texts"), kind, budget, language).alias("user"))
        back = F.from_json("id", f"k string, place {df.schema['place'].dataType.simpleString()}")
        return providers.complete(asked, endpoint, "id").select(back.alias("b"), T.trim(F.col("text")).alias("text")).select(F.col("b.k").alias(key), "b.place", "text")

    return FrameReduce(run)


def _apply(df: DataFrame, key: str, reduce: Reduce) -> DataFrame:
    """``key, _t, _s``: the texts of each row reduced to one; single texts are kept."""
    if not isinstance(reduce, FrameReduce):
        text = F.when(F.size("texts") > 1, reduce(F.col("texts"))).otherwise(F.get("texts", F.lit(0)))
        return df.select(key, text.alias("_t"), F.col("place").alias("_s"))
    one = df.filter(F.size("texts") == 1).select(key, F.get("texts", F.lit(0)).alias("_t"), F.col("place").alias("_s"))
    return one.unionByName(reduce.run(df.filter(F.size("texts") > 1), key).select(key, F.col("text").alias("_t"), F.col("place").alias("_s")))


def _described(heads: DataFrame, rows: DataFrame, key: str, text: str, seq: list[str], reduce: Reduce, budget: int, context: int) -> DataFrame:
    """``heads`` with ``n_descriptions`` and the merged ``description`` of each key; '' where it has none."""
    kept = rows.filter(F.coalesce(F.col(text), F.lit("")) != "")
    counted = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n_descriptions"))
    summed = summarise(kept, key, text, seq, reduce, budget, context)
    out = heads.join(counted, key, "left").join(summed.select(key, "description"), key, "left")
    return out.withColumns({"n_descriptions": F.coalesce("n_descriptions", F.lit(0)), "description": F.coalesce("description", F.lit(""))})


def merge_entities(mentions: DataFrame, seq: list[str], name: str = "name", type_col: str = "type", text: str = "description", sources: str = "source_ids",
                   reduce: Reduce = providers.canned(), budget: int = BUDGET, context: int = CONTEXT) -> DataFrame:
    """``name, type, n_mentions, n_descriptions, n_sources, description``.

    The type of the first mention (by ``seq``, nulls first), distinct non-empty
    sources counted, the descriptions joined or, where they are many, summarised by
    ``reduce``.  Empty names are dropped.
    """
    named = mentions.filter(F.coalesce(F.col(name), F.lit("")) != "").select(*dict.fromkeys([name, type_col, text, sources, *seq]))
    # Read several times below, and often the result of an aggregation itself.
    named = materialise(named, "merging-mentions")
    # The struct keeps a first type that is null.
    heads = named.groupBy(name).agg(F.min_by(F.struct(F.col(type_col).alias("type")), F.struct(*seq)).alias("h"), F.count(F.lit(1)).alias("n_mentions"))
    pairs = named.select(name, F.explode(sources).alias("s")).filter("s <> ''").distinct().groupBy(name).agg(F.count(F.lit(1)).alias("n_sources"))
    out = _described(heads.join(pairs, name, "left"), named, name, text, seq, reduce, budget, context)
    return out.select(name, "h.type", "n_mentions", "n_descriptions", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "description")


def entity_sources(mentions: DataFrame, name: str = "name", sources: str = "source_ids", segment: int = BLOCK) -> DataFrame:
    """``name, segment_no, n_elements, elements``: the sorted source ids of each name, in segments."""
    return hotkeys.merged_lists(mentions, name, sources, segment)


def relation_sources(relations: DataFrame, segment: int = BLOCK) -> DataFrame:
    """``src_id, tgt_id, segment_no, n_elements, elements``: the sorted source ids of each canonical pair, in segments."""
    from quern.operators.graph import keyed

    lists = hotkeys.merged_lists(keyed(relations).select(_pair(), "source_ids"), "_pair", "source_ids", segment)
    return lists.select(F.from_json("_pair", _PAIR).alias("p"), "*").select(F.col("p.a").alias("src_id"), F.col("p.b").alias("tgt_id"), "segment_no", "n_elements", "elements")


_PAIR = "a string, b string"


def _pair() -> Column:
    """The two ends as one key."""
    return F.to_json(F.struct("a", "b")).alias("_pair")


def merge_relations(relations: DataFrame, seq: list[str], reduce: Reduce = providers.canned(), budget: int = BUDGET, context: int = CONTEXT) -> DataFrame:
    """``src_id, tgt_id, weight, keywords, n_relations, n_sources, description`` per canonical pair.

    Weights are summed, distinct whole keyword strings joined in the order first
    seen, descriptions as in :func:`merge_entities`.  Invalid edges are dropped.
    """
    from quern.operators.graph import keyed

    key = "_pair"
    edges = keyed(relations).select(_pair(), *dict.fromkeys(["weight", "keywords", "source_ids", "description", *seq]))
    edges = materialise(edges, "merging-relations")
    # In thousandths, so the sum does not depend on the order of addition.
    heads = edges.groupBy(key).agg((F.sum(F.round(F.col("weight") * 1000).cast("long")) / 1000).alias("weight"), F.count(F.lit(1)).alias("n_relations"))
    words = (edges.filter("keywords <> ''").groupBy(key, "keywords").agg(F.min(F.struct(*seq)).alias("s"))
             .groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "keywords"))), lambda x: x["keywords"]), ",").alias("keywords")))
    pairs = edges.select(key, F.explode("source_ids").alias("s")).filter("s <> ''").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"))
    out = _described(heads.join(words, key, "left").join(pairs, key, "left"), edges, key, "description", seq, reduce, budget, context)
    return out.withColumn("p", F.from_json(key, _PAIR)).select(
        F.col("p.a").alias("src_id"), F.col("p.b").alias("tgt_id"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("keywords", F.lit("")).alias("keywords"), "n_relations",
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "description")


def blocks(df: DataFrame, key: str, text: str, seq: list[str], block: int = BLOCK) -> DataFrame:
    """``key, block_no, parts``: descriptions in order, in blocks of ``block``.

    Block ``i`` holds the texts numbered ``i * block ..`` of the key by ``seq``.  Keys
    of one block are gathered as they are; larger ones are numbered by
    :func:`hotkeys.numbered_in_order`, so no task orders a whole key.
    """
    kept = df.filter((F.coalesce(F.col(key), F.lit("")) != "") & (F.coalesce(F.col(text), F.lit("")) != "")).select(key, F.col(text).alias("_d"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(seq)])
    order = [f"_q{i}" for i in range(len(seq))]
    sized = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select(key)
    large = materialise(sized, "merging-large")
    placed = kept.join(large, key, "left_anti").withColumn("block_no", F.lit(0))
    if not large.isEmpty():
        ranked = hotkeys.numbered_in_order(kept.join(large, key, "left_semi"), key, order, block)
        placed = placed.unionByName(ranked.select(*kept.columns, F.col("chunk_no").cast("int").alias("block_no")))
    gathered = placed.groupBy(key, "block_no").agg(F.array_sort(F.collect_list(F.struct(*order, "_d"))).alias("p"))
    return gathered.select(key, "block_no", F.transform("p", lambda x: x["_d"]).alias("parts"))


def windows(df: DataFrame, key: str, text: str, seq: list[str], context: int = CONTEXT) -> DataFrame:
    """``key, block_no, window_no, texts``: descriptions packed greedily into summary windows."""
    packed = blocks(df, key, text, seq)
    return packed.select(key, "block_no", F.posexplode(pack_greedily(F.col("parts"), context)).alias("window_no", "texts"))


def _reduced(todo: DataFrame, key: str, reduce: Reduce) -> DataFrame:
    """``key, description``: blocks of texts reduced, then blocks of the results, until each key has one text.

    A round leaves a text a block, so a key of ``n`` texts takes about ``log n / log BLOCK`` rounds.
    """
    done = None
    while True:
        packed = materialise(_apply(blocks(todo, key, "_t", ["_s"]).select(key, F.col("parts").alias("texts"), F.struct("block_no").alias("place")), key, reduce), "summaries")
        many = packed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
        one = packed.join(many, key, "left_anti").select(key, F.col("_t").alias("description"))
        done = one if done is None else done.unionByName(one)
        todo = packed.join(many, key, "left_semi")
        if todo.isEmpty():
            return done


def _texts(df: DataFrame, key: str, text: str, seq: list[str]) -> DataFrame:
    return df.select(key, F.col(text).alias("_t"), F.struct(*seq).alias("_s")).filter((F.coalesce(F.col(key), F.lit("")) != "") & (F.coalesce("_t", F.lit("")) != ""))


def _sized(todo: DataFrame, key: str, budget: int, count: int) -> DataFrame:
    """``key, final``: whether the texts of a key are joined as they are."""
    n, tokens = F.count(F.lit(1)), F.sum(T.token_count(F.col("_t")))
    return todo.groupBy(key).agg(((n == 1) | ((n < count) & (tokens < budget))).alias("final"))


def _joined(todo: DataFrame, sized: DataFrame, key: str) -> DataFrame:
    """``key, description`` of the keys that are joined as they are, each of fewer texts than the least count."""
    few = todo.join(sized.filter("final").select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_s", "_t"))).alias("p"))
    return few.select(key, F.array_join(F.transform("p", lambda x: x["_t"]), "\n\n").alias("description"))


def unsummarised(df: DataFrame, key: str, text: str, seq: list[str], budget: int = BUDGET, count: int = COUNT) -> DataFrame:
    """``key, description`` of the keys that need no summary."""
    todo = _texts(df, key, text, seq)
    return _joined(todo, _sized(todo, key, budget, count), key)


def summarise(df: DataFrame, key: str, text: str, seq: list[str], reduce: Reduce, budget: int = BUDGET, context: int = CONTEXT,
              count: int = COUNT, depth: int = DEPTH) -> DataFrame:
    """``key, description, llm_used``: map-reduce summary of each key's descriptions.

    ``reduce`` turns several texts into one summary.  Groups below ``count`` texts
    and ``budget`` tokens are joined; others are packed, windows of several texts
    reduced and single ones kept, until the result is small enough.  After ``depth``
    rounds every block of what is left is reduced, then the blocks of those
    summaries, until a key has one text.
    """
    todo = materialise(_texts(df, key, text, seq), "summaries-texts")
    used, done = F.lit(False), None
    for level in range(depth + 1):
        sized = materialise(_sized(todo, key, budget, count), "summaries-sized")
        ready = _joined(todo, sized, key).withColumn("llm_used", used)
        done = ready if done is None else done.unionByName(ready)
        rest = sized.filter("not final").select(key)
        if rest.isEmpty():
            return done
        left = todo.join(rest, key, "left_semi")
        if level == depth:
            return done.unionByName(_reduced(left, key, reduce).withColumn("llm_used", F.lit(True)))
        packed = windows(left, key, "_t", ["_s"], context).select(key, "texts", F.struct("block_no", "window_no").alias("place"))
        todo = materialise(_apply(packed, key, reduce), "summaries")
        used = F.lit(True)
    return done
