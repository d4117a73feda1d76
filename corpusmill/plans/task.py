"""Search and query as whole tasks: retrieve, judge along a frontier, answer, combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.answers import keeps
from corpusmill.operators import retrieval
from corpusmill.operators.cache_table import CacheTable, through
from corpusmill.operators.frontier import judge_frontier
from corpusmill.operators.lineage import checkpointed
from corpusmill.operators.search import minmax_hits, search
from corpusmill.operators.similar import redundant_ids
from corpusmill.operators.topk import top_k as cut_to
from corpusmill.plans.query import DEFAULT_TOP_K, GROW_FROM_SHARE, answer_questions, join_answers, top_k_steps

# The retrievers there are, in the order in which their hits are interleaved, and how alike two chunks may be.
RETRIEVERS = ("multiquery", "knn", "svm", "parent", "basic")
REDUNDANT = 0.999


def chosen_retrievers(setting: str) -> list[str]:
    """The retrievers a setting names, such as ``basic_multiquery``."""
    low = setting.lower()
    names = [name for name in RETRIEVERS if name in low]
    if not names or set(low.replace(",", "_").split("_")) - set(RETRIEVERS):
        raise ValueError(f"no such retrievers: {setting!r}; there are {', '.join(RETRIEVERS)}")
    return names


def expanded(questions: DataFrame, expand: Callable[[Column], Column], embed: Callable[[Column], Column]) -> DataFrame:
    """(query_id, subquery_id, embedding) of the rephrasings a model gives of each question, and of the question itself.

    ``expand`` gives an array of strings; blank and repeated ones are left out.
    """
    own = F.transform(F.coalesce(expand(F.col("question")), F.array().cast("array<string>")), F.trim)
    phrases = F.array_distinct(F.filter(F.concat(F.array("question"), own), lambda p: p.isNotNull() & (p != "")))
    rows = checkpointed(questions.select("query_id", F.posexplode(phrases).alias("subquery_id", "phrase")))
    return rows.select("query_id", "subquery_id", embed(F.col("phrase")).alias("embedding"))


def retrieve(setting: str, questions: DataFrame, vectors: DataFrame, k: int, threshold: float = -0.5, *,
             parents: DataFrame | None = None, expand: Callable[[Column], Column] | None = None,
             embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, chunk_id, rank) of the chunks that the chosen retrievers find, at most ``k`` from each.

    ``questions``: query_id, embedding, and ``question`` where questions are expanded.
    ``vectors``: chunk_id, embedding. ``parents``: chunk_id, parent_id, where the parent is a
    chunk too. The hits of several retrievers are interleaved, a chunk at its first place, and
    chunks that repeat one of a smaller id are left out.
    """
    found = []
    for name in chosen_retrievers(setting):
        if name == "multiquery":
            if expand is None or embed is None:
                raise ValueError("multiquery needs a model that rephrases and one that embeds")
            hits = retrieval.multi_query(vectors, expanded(questions, expand, embed), k, threshold)
            hits = cut_to(hits, ["query_id"], [F.col("best_rank"), F.desc("score"), F.col("chunk_id")], k)
        elif name == "knn":
            hits = minmax_hits(vectors, questions, k, threshold)
        elif name == "svm":
            hits = retrieval.svm_hits(vectors, questions, k, threshold)
        elif name == "parent":
            if parents is None:
                raise ValueError("parent needs the parents of the chunks")
            over = retrieval.parents_of(search(vectors, questions, k, threshold), parents)
            hits = cut_to(over.withColumnRenamed("parent_id", "chunk_id"), ["query_id"], [F.col("best_rank"), F.col("chunk_id")], k)
        else:
            hits = search(vectors, questions, k, threshold)
        found.append(hits.select("query_id", "chunk_id", "rank"))
    if len(found) == 1:
        return found[0]
    merged = checkpointed(retrieval.merge([checkpointed(h) for h in found]))
    placed = merged.join(vectors.select("chunk_id", "embedding"), "chunk_id")
    again = redundant_ids(placed, REDUNDANT, "chunk_id", ("query_id",))
    left = merged.join(again, ["query_id", "chunk_id"], "left_anti")
    return cut_to(left, ["query_id"], [F.col("rank"), F.col("retriever"), F.col("chunk_id")], len(found) * k, rank="place").select(
        "query_id", "chunk_id", F.col("place").alias("rank"))


@dataclass
class Models:
    """What a task asks. ``judge`` and ``answer`` get rows with question and text and return them with ``value``:
    an array of votes, and an answer."""

    judge: Callable[[DataFrame], DataFrame]
    answer: Callable[[DataFrame], DataFrame]
    embed: Callable[[Column], Column]
    combine: Callable[[Column], Column] = join_answers
    expand: Callable[[Column], Column] | None = None
    name: str = "built-in"


@dataclass
class Found:
    """The chunks a search kept, the size each question ended at, and the judge's calls at each size."""

    kept: DataFrame
    sizes: DataFrame
    calls: list[int]


def search_task(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, models: Models, votes: CacheTable,
                retrievers: str = "basic", top_k: int | str = DEFAULT_TOP_K, threshold: float = -0.5,
                parents: DataFrame | None = None) -> Found:
    """Chunks relevant to each question. ``questions``: query_id, question, embedding; ``chunks``: chunk_id, text.

    A vote is asked for a question, a text and a model, once, also over later tasks that
    share ``votes``. Texts are joined for pairs that are asked for, not for all hits.
    """
    steps = top_k_steps(top_k)
    hits = retrieve(retrievers, questions, vectors, steps[-1], threshold, parents=parents, expand=models.expand, embed=models.embed)
    asked = questions.select("query_id", "question")
    marked = checkpointed(hits.where(F.col("rank") <= steps[-1])).join(
        chunks.select("chunk_id", F.sha2("text", 256).alias("text_hash")), "chunk_id").join(asked, "query_id")
    pair = F.sha2(F.to_json(F.struct("question", "text_hash", F.lit(models.name).alias("model"), F.lit("judge").alias("task"))), 256)

    def judge(lacking: DataFrame) -> DataFrame:
        return models.judge(lacking.join(chunks.select("chunk_id", "text"), "chunk_id"))

    judged, sizes, calls = judge_frontier(marked, pair, judge, keeps, steps, GROW_FROM_SHARE, votes)
    return Found(checkpointed(judged.where("keep")), sizes, calls)


def query_task(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, models: Models, votes: CacheTable,
               replies: CacheTable, retrievers: str = "basic", top_k: int | str = DEFAULT_TOP_K, threshold: float = -0.5,
               parents: DataFrame | None = None, prefix: str = "DOC_") -> tuple[DataFrame, Found, int]:
    """One sourced answer per question that found a chunk, the search behind it, and the answerer's calls."""
    found = search_task(questions, vectors, chunks, models, votes, retrievers, top_k, threshold, parents)
    key = F.sha2(F.to_json(F.struct("question", "text_hash", F.lit(models.name).alias("model"), F.lit("answer").alias("task"))), 256)

    def answer(lacking: DataFrame) -> DataFrame:
        return models.answer(lacking.join(chunks.select("chunk_id", "text"), "chunk_id"))

    answered, calls = through(replies, found.kept.withColumn("reply_key", key), "reply_key", answer)
    answered = checkpointed(answered.select("query_id", "chunk_id", "rank", F.col("value").alias("given")))
    return answer_questions(answered, F.col("given"), models.embed, models.combine, prefix), found, calls
