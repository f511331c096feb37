"""Questions on one set of pages: index them, ask, forget them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lodestrata.functions.text import lexical_tokens
from lodestrata.operators import chunker, prompts, ranking, tables
from lodestrata.session import cut


class EvidenceService:
    """Row and prose units of pages, searched by words and vectors, fused and made diverse.

    encode(texts, key, text) gives (key, embedding); without one, vectors are hashed words.
    """

    def __init__(self, encode: Callable[[DataFrame, str, str], DataFrame] = ranking.hashed_vectors, limits: chunker.Limits = chunker.Limits()) -> None:
        self.encode, self.limits = encode, limits
        self.units: DataFrame | None = None
        self.vectors: DataFrame | None = None

    def index(self, pages: DataFrame) -> DataFrame:
        """Index pages (document_id, page_number, markdown, source_element_ids) in place of what was indexed."""
        chunks = chunker.markdown_units(pages, self.limits).withColumn("document_sha256", F.lit(None).cast("string")).withColumn("filename", F.lit(None).cast("string"))
        units = tables.table_row_units(chunks)
        self.units = cut(units.where(F.size(lexical_tokens(F.col("text"))) > 0))
        self.vectors = cut(self.encode(self.units, "chunk_id", "text"))
        return self.units

    def search(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Rankings of questions (query_id, document_id, query_text); nothing indexed raises."""
        if self.units is None or self.vectors is None:
            raise ValueError("nothing is indexed")
        return ranking.hybrid(self.units, questions, self.vectors, self.encode(questions, "query_id", "query_text"), k=k)

    def ask(self, questions: DataFrame, generate: Callable[[str, str], str], k: int = 5) -> DataFrame:
        """(query_id, answer, citations) of questions; generate(system, user) runs in the executors' Python."""
        found = cut(self.search(questions, k).select("query_id", "chunk_id", "rank"))
        asked = prompts.grounded_prompts(questions, found, self.units)

        def said(frames):  # noqa: ANN001, ANN202
            for pdf in frames:
                yield pdf[["query_id"]].assign(answer=[generate(s, u) for s, u in zip(pdf["system"], pdf["user"])])

        kind = questions.schema["query_id"].dataType.simpleString()
        answers = asked.select("query_id", "system", "user").mapInPandas(said, f"query_id {kind}, answer string")
        cited = prompts.citations(found, self.units).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_number", "chunk_id", "page_label"))).alias("citations"))
        return answers.join(cited, "query_id", "left")

    def clear(self) -> None:
        self.units = self.vectors = None
