"""The knowledge base as a set of questions: one method for each read that a user of the base can ask for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import preview
from .operators import graph, retrieval


@dataclass(frozen=True)
class KnowledgeBase:
    """owners (owner_id, name, description), files (file_id, owner_id, name), chunks (chunk_id, file_id, start_line, text,
    label_id), articles (article_id, title, summary, full_text, label_ids), labels (label_id, name, description, group_name),
    index (chunk_id, text, embedding); edges (src, dst, type) between node ids."""

    owners: DataFrame
    files: DataFrame
    chunks: DataFrame
    articles: DataFrame
    labels: DataFrame
    index: DataFrame
    edges: DataFrame

    def counts(self) -> DataFrame:
        parts = [d.agg(F.lit(x).alias("kind"), F.count("*").alias("n")) for x, d in (("document", self.articles), ("software", self.owners))]
        return parts[0].unionByName(parts[1])

    def label_description(self, label_id) -> DataFrame:
        return self.labels.where(F.col("label_id") == label_id).select("label_id", "name", "description")

    def by_label(self, label_id) -> DataFrame:
        """(kind, id, name): the articles and, once each, the owners that a label leads to."""
        articles = self.articles.where(F.array_contains("label_ids", label_id))
        files = self.chunks.where(F.col("label_id") == label_id).select("file_id").distinct()
        owners = self.owners.join(self.files.join(files, "file_id", "left_semi").select("owner_id"), "owner_id", "left_semi")
        row = lambda d, kind, key, name: d.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
        return row(articles, "document", "article_id", "title").unionByName(row(owners, "software", "owner_id", "name"))

    def articles_by_label(self, label_id, n: int = 100) -> DataFrame:
        found = self.articles.where(F.array_contains("label_ids", label_id))
        return found.select("article_id", "title", preview(F.col("summary"), n).alias("preview")).orderBy(F.asc_nulls_last("title"), "article_id")

    def details(self, requests: DataFrame) -> DataFrame:
        """(pos, id, kind, found, name, text) of requests (pos, id, kind), kind being document or software. Other kinds are
        dropped; ids that aren't there come with found false. A software's text is its chunks, file after file, in line order."""
        asked = requests.where(F.col("kind").isin("document", "software"))
        documents = asked.where("kind = 'document'").join(
            self.articles.select(F.col("article_id").cast("string").alias("id"), F.col("title").alias("name"), F.col("full_text").alias("text"), F.lit(True).alias("found")), "id", "left"
        )
        ids = asked.where("kind = 'software'").select("id").distinct()
        owners = self.owners.withColumn("id", F.col("owner_id").cast("string")).join(ids, "id", "left_semi")
        files = self.files.join(owners.select("owner_id", "id"), "owner_id").join(self.chunks, "file_id")
        per_file = graph.ordered_text(files, ["id", "file_id"], "start_line", "text", "\n\n")
        whole = graph.ordered_text(per_file, ["id"], "file_id", "text", "\n\n")
        owners = owners.select("id", "name", F.lit(True).alias("found")).join(whole, "id", "left")
        software = asked.where("kind = 'software'").join(owners, "id", "left")
        columns = ["pos", "id", "kind", F.coalesce("found", F.lit(False)).alias("found"), "name", "text"]
        return documents.select(*columns).unionByName(software.select(*columns)).orderBy("pos")

    def _page(self, rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
        return graph.page(rows, order, number, size)

    def all_articles(self, number: int = 1, size: int = 50, n: int = 200) -> DataFrame:
        rows = self.articles.select("article_id", "title", preview(F.col("summary"), n).alias("preview"))
        return self._page(rows, [F.asc_nulls_last("title"), F.asc("article_id")], number, size)

    def all_owners(self, number: int = 1, size: int = 50, n: int = 200) -> DataFrame:
        rows = self.owners.select("owner_id", "name", preview(F.col("description"), n).alias("preview"))
        return self._page(rows, [F.asc_nulls_last("name"), F.asc("owner_id")], number, size)

    def labels_of_owner(self, owner_id) -> DataFrame:
        """(group_name, names, n): the labels that an owner's chunks carry, each once, by group; no group is one of its own."""
        chunks = self.chunks.join(self.files.where(F.col("owner_id") == owner_id).select("file_id"), "file_id", "left_semi")
        found = self.labels.join(chunks.select("label_id").distinct(), "label_id", "left_semi")
        names = F.transform(F.sort_array(F.collect_list(F.struct("name", "label_id"))), lambda x: x["name"])
        return found.groupBy("group_name").agg(F.array_join(names, ",").alias("names"), F.count("*").alias("n"))

    def query(self, questions: DataFrame, score: Column | None = None) -> DataFrame:
        """Answers to questions (query_id, question, vector): vector and fused hits, reranked, with the chunk's own row."""
        hits = retrieval.retrieve(questions, self.index, "chunk_id", "text", "embedding", score)
        return hits.join(self.index.select(F.col("chunk_id").alias("id"), "text"), "id")

    def expanded_query(self, questions: DataFrame, k: int = 3, score: Column | None = None) -> DataFrame:
        """Neighbours, over two edges, of the k best vector hits of each question after reranking."""
        return retrieval.expanded(questions, self.index, self.edges, "chunk_id", "text", "embedding", k, score)
