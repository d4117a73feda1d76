"""Answering questions: retrieve, judge, answer, combine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.answers import is_relevant, keeps
from corpusmill.functions.text import collate_line, est_tokens, source_replace, wrap_source
from corpusmill.operators.batching import semantic_batches
from corpusmill.operators.lineage import checkpointed
from corpusmill.operators.search import hits_with, search

# Growth of top-k.
GROWTH = 1.5
GROW_FROM_SHARE = 0.9
DEFAULT_TOP_K = "auto_200_500"


def parse_top_k(top_k: int | str) -> tuple[int, int | None]:
    """``auto_N_M`` starts at N and may grow to M; a number stays as it is."""
    if isinstance(top_k, str) and top_k.startswith("auto_"):
        low, high = (int(p) for p in top_k.split("_")[1:])
        if not 0 < low <= high:
            raise ValueError(f"bad top_k {top_k!r}")
        return low, high
    if int(top_k) < 1:
        raise ValueError("top_k must be at least 1")
    return int(top_k), None


def top_k_steps(top_k: int | str) -> list[int]:
    """The sizes that would be tried in turn."""
    k, limit = parse_top_k(top_k)
    steps = [k]
    while limit and steps[-1] < limit:
        steps.append(min(max(steps[-1] + 1, int(steps[-1] * GROWTH)), limit))
    return steps


def adaptive_cut(judged: DataFrame, top_k: int | str) -> DataFrame:
    """Per question, the first size at which fewer than nine in ten hits are kept, or the largest.

    ``judged``: query_id, rank, keep, retrieved once at the largest size. All
    sizes are counted in one aggregate, so growing costs no second search.
    """
    steps = top_k_steps(top_k)
    counts = judged.groupBy("query_id").agg(*[
        F.count_if(F.col("keep") & (F.col("rank") <= k)).alias(f"_k{i}") for i, k in enumerate(steps)])
    chosen = F.when(F.lit(False), F.struct(F.lit(0).alias("top_k"), F.lit(0).cast("bigint").alias("n_kept")))
    for i, k in enumerate(steps):
        last = i == len(steps) - 1
        stop = F.lit(True) if last else (F.col(f"_k{i}") / k) < GROW_FROM_SHARE
        chosen = chosen.when(stop, F.struct(F.lit(k).alias("top_k"), F.col(f"_k{i}").alias("n_kept")))
    picked = counts.select("query_id", chosen.alias("c")).select("query_id", "c.*")
    return picked.withColumn("kept_ratio", F.col("n_kept") / F.col("top_k"))


def search_docs(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, evaluate, top_k: int | str = DEFAULT_TOP_K,
                threshold: float = -0.5) -> DataFrame:
    """Chunks relevant to each question.

    Text is only joined for the hits: the scan that ranks reads vectors alone.
    ``evaluate(question, chunk columns)`` gives the votes.
    """
    largest = top_k_steps(top_k)[-1]
    # both stored: the vectors are scanned once, and no vote is asked for twice
    hits = checkpointed(search(vectors, questions, largest, threshold))
    with_text = hits_with(hits, chunks, "chunk_id")
    facts = questions.drop("embedding")
    if len(facts.columns) > 1:
        with_text = with_text.join(facts, "query_id")
    judged = with_text.withColumn("votes", evaluate(with_text)).withColumn("keep", keeps(F.col("votes")))
    judged = checkpointed(judged)
    cut = adaptive_cut(judged, top_k)
    return judged.join(cut, "query_id").filter(F.col("keep") & (F.col("rank") <= F.col("top_k")))


def numbered_answers(kept: DataFrame, answer: Column, prefix: str = "DOC_") -> DataFrame:
    """Answers worth keeping, numbered per question in rank order and wrapped with their id."""
    answered = kept.withColumn("answer", answer).filter(is_relevant(F.col("answer")))
    # at most top-k rows per question reach this window
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return (answered.withColumn("source_no", place)
            .withColumn("wrapped", wrap_source(F.col("source_no"), F.col("answer"), prefix)))


def join_answers(answers: Column) -> Column:
    """Stand-in combiner: the answers of a batch, collated."""
    return F.array_join(F.transform(answers, collate_line), "\n")


def _combined(batched: DataFrame, combine: Callable[[Column], Column]) -> DataFrame:
    """``batched`` with ``answer``: a batch whose combiner gives nothing is asked once more, and else written down in order."""
    answers = F.transform("_a", lambda s: s["answer"])
    asked = checkpointed(batched.withColumn("answer", combine(answers)))
    failed = asked.where(F.col("answer").isNull())
    if failed.isEmpty():
        return asked
    again = checkpointed(failed.drop("answer").withColumn("answer", combine(answers)))
    return asked.where(F.col("answer").isNotNull()).unionByName(
        again.withColumn("answer", F.coalesce("answer", F.array_join(answers, "\n---\n"))))


def reduce_answers(answers: DataFrame, embed: Callable[[Column], Column],
                   combine: Callable[[Column], Column] = join_answers, cap: int = 2_000) -> DataFrame:
    """Combine the answers of each question batch by batch until one is left.

    ``answers``: query_id, part (number), answer. Returns query_id, answer, rounds.
    Every batch holds at least two answers, so each round at least halves them;
    the state between rounds is stored, not recomputed. A ``combine`` that gives null is
    asked again; a batch that fails twice keeps its answers, one after another.
    """
    first_of = answers.groupBy("query_id", "answer").agg(F.min("part").alias("part"))
    state = checkpointed(first_of.withColumn("rounds", F.lit(0)))
    before = None
    while True:
        sizes = state.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        open_ids = sizes.filter("n > 1").select("query_id")
        left = sizes.agg(F.sum("n")).first()[0]
        if open_ids.isEmpty():
            return state.select("query_id", "answer", "rounds")
        if left == before:
            raise RuntimeError("a round combined nothing")
        before = left
        active = state.join(open_ids, "query_id", "left_semi")
        done = state.join(open_ids, "query_id", "left_anti")
        placed = semantic_batches(
            active.select("query_id", "part", est_tokens(F.col("answer")).alias("tokens"), embed(F.col("answer")).alias("embedding")),
            ["query_id"], "part", cap)
        batched = (placed.join(active, ["query_id", "part"]).groupBy("query_id", "batch", "rounds")
                   .agg(F.array_sort(F.collect_list(F.struct("pos", "answer"))).alias("_a")))
        combined = _combined(batched, combine).select("query_id", F.col("batch").alias("part"), "answer",
                                                      (F.col("rounds") + 1).alias("rounds"))
        state = checkpointed(done.unionByName(combined.withColumn("part", F.col("part").cast(
            state.schema["part"].dataType)).select(*done.columns)))


def answer_questions(kept: DataFrame, answer: Column, embed, combine=join_answers, prefix: str = "DOC_") -> DataFrame:
    """One sourced answer per question.

    No relevant answer is an error text, a single one is returned with its
    source, more are reduced. Missing sources are reported by number.
    """
    numbered = numbered_answers(kept, answer, prefix)
    sources = numbered.groupBy("query_id").agg(F.array_sort(F.collect_set("source_no")).alias("sources"))
    final = reduce_answers(numbered.select("query_id", F.col("source_no").alias("part"), F.col("wrapped").alias("answer")),
                           embed, combine).join(sources, "query_id")
    single = F.size("sources") == 1
    shown = F.when(single, F.concat(F.lit(f"Source identifier: [[{prefix}1]]\n"), "answer")).otherwise(F.col("answer"))
    final = final.withColumn("answer", shown)
    missing = F.filter("sources", lambda n: ~F.contains("answer", F.concat(F.lit(prefix), n.cast("string"))))
    linked = final.select("query_id", "rounds", "sources", missing.alias("missing_sources"),
                          source_replace(F.col("answer"), F.col("sources"), prefix).alias("answer"))
    asked = kept.select("query_id").distinct()
    return (asked.join(linked, "query_id", "left")
            .withColumn("error", F.when(F.col("answer").isNull(), F.lit("no relevant intermediate answer"))))
