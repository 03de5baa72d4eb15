"""The graph behind one object: a method for each thing that callers ask of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx
from graphloom.operators import audit, dedup, evaluate, graph, predict, proof, retrieval, rules, search, vectors
from graphloom.sources.store import Store


class Engine:
    """Queries over entities (id, type, name, description, jurisdiction, claim_type, outcome ...), edges (src, dst, type) and chunks."""

    def __init__(self, entities: DataFrame, edges: DataFrame, chunks: DataFrame | None = None) -> None:
        self.entities, self.edges, self.chunks = entities, edges, chunks

    @classmethod
    def open(cls, store: Store) -> Engine:
        return cls(store.read("entities"), store.read("edges"), store.read("chunks"))

    # Entities and edges

    def entity(self, *ids: str) -> DataFrame:
        """By id, or by the part after the type."""
        return self.entities.filter(F.col("id").isin(*ids) | F.regexp_replace("id", "^[^:]*:", "").isin(*ids))

    def list_entities(self, types: Sequence[str] = (), text: str | None = None, jurisdiction: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        rows = self.entities
        if types:
            rows = rows.filter(F.col("type").isin(*types))
        if jurisdiction:
            rows = rows.filter(F.col("jurisdiction") == jurisdiction)
        if text:
            rows = rows.filter(F.lower(F.concat_ws(" ", "name", "description")).contains(text.lower()))
        return search.page(rows, offset, limit)

    def relationships(self, src: str | None = None, dst: str | None = None, kind: str | None = None) -> DataFrame:
        rows = self.edges
        for column, value in (("src", src), ("dst", dst), ("type", kind)):
            rows = rows if value is None else rows.filter(F.col(column) == value)
        return rows

    def neighbours(self, ids: DataFrame, per_node: int = 10) -> DataFrame:
        return graph.neighbours(self.edges, ids, per_node)

    def subgraph(self, ids: DataFrame) -> DataFrame:
        return graph.induced(self.edges, ids)

    def delete(self, ids: DataFrame) -> Engine:
        left, lines = graph.delete_entities(self.entities, self.edges, ids)
        return Engine(left, lines, self.chunks)

    # Search

    def search(self, queries: DataFrame, types: Sequence[str] = d.RETRIEVAL_TYPES, top: int = 10, all_terms: bool = False) -> DataFrame:
        """BM25 over name and description for a batch of queries (query_id, text)."""
        return search.search(queries, self.entities.filter(F.col("type").isin(*types)).select("id", "name", "description"), ["name", "description"], top, all_terms)

    def similar_chunks(self, queries: DataFrame, top: int = 10, where: str | None = None) -> DataFrame:
        """Cosine over chunk vectors for a batch of queries (query_id, embedding); rows of chunks need a numeric id."""
        rows = self.chunks if where is None else self.chunks.filter(where)
        return vectors.top_k(queries, rows.select("id", "embedding"), top)

    def retrieve(self, linked: DataFrame, queries: DataFrame, top: int = 20, per_node: int = 10) -> DataFrame:
        """Linked entities, lexical hits and their neighbours for a batch of queries, deduplicated in this order."""
        allowed = self.entities.filter(F.col("type").isin(*d.RETRIEVAL_TYPES)).select("id")
        return retrieval.hybrid(linked, self.search(queries, top=top).select("query_id", "id", "rank"), self.edges, allowed, per_node, top)

    def context(self, before: int = 1, after: int = 1) -> DataFrame:
        return graph.window_context(self.chunks, before, after)

    def expand(self, ids: DataFrame, per_node: int = 10) -> tuple[DataFrame, DataFrame]:
        """(entities, edges) of some entities (id) and their neighbours, at most ``per_node`` of each in each direction."""
        near = self.neighbours(ids, per_node).select(F.col("other").alias("id"))
        held = ids.select("id").unionByName(near).distinct()
        return self.entities.join(held, "id", "left_semi"), graph.induced(self.edges, held)

    # Chunks

    def find_chunks(self, where: str | None = None, source_id: str | None = None, text: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        """A page of chunks by payload condition, source and words, in order of their ids."""
        rows = self.chunks if where is None else self.chunks.filter(where)
        if source_id is not None:
            rows = rows.filter(F.col("source_id") == source_id)
        if text:
            rows = rows.filter(F.lower("text").contains(text.lower()))
        return search.page(rows, offset, limit, "chunk_id")

    def chunk(self, *ids: str) -> DataFrame:
        return self.chunks.filter(F.col("chunk_id").isin(*ids))

    def chunks_of_entity(self, *ids: str) -> DataFrame:
        """Chunks that an entity names, or that name it, in the order of their sources."""
        own = self.entities.filter(F.col("id").isin(*ids)).select(F.col("id").alias("entity_id"), F.explode("chunk_ids").alias("chunk_id"))
        back = self.chunks.select("chunk_id", F.explode("entities").alias("entity_id")).filter(F.col("entity_id").isin(*ids))
        return self.chunks.join(own.unionByName(back.select("entity_id", "chunk_id")).distinct(), "chunk_id").orderBy("entity_id", "source_id", "chunk_index")

    def entities_of_chunk(self, *ids: str) -> DataFrame:
        """Entities that name a chunk, or that it names."""
        own = self.entities.select("id", F.explode("chunk_ids").alias("chunk_id")).filter(F.col("chunk_id").isin(*ids))
        back = self.chunks.filter(F.col("chunk_id").isin(*ids)).select(F.explode("entities").alias("id"), "chunk_id")
        return self.entities.join(own.unionByName(back).distinct(), "id")

    def adjacent(self, *ids: str) -> DataFrame:
        """chunk_id, prev_chunk_id, next_chunk_id of some chunks; only their sources are put in order."""
        near = self.chunks.join(self.chunk(*ids).select("source_id").distinct(), "source_id", "left_semi")
        return graph.adjacent(near).filter(F.col("chunk_id").isin(*ids))

    def best_quote(self, *ids: str) -> DataFrame:
        """id and quote: the stored best quote of an entity, or the sentence of its chunks that names it best."""
        held = self.entities.filter(F.col("id").isin(*ids))
        stored = held.filter("best_quote.text is not null").select("id", F.col("best_quote.text").alias("quote"))
        texts = self.chunks_of_entity(*ids).select(F.col("entity_id").alias("id"), "source_id", "chunk_index", "text")
        joined = texts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("source_id", "chunk_index", "text"))).alias("t"))
        open_ = held.join(stored.select("id"), "id", "left_anti").join(joined, "id").select(F.col("id").alias("key"), "name", F.array_join("t.text", "\n").alias("text"))
        return stored.unionByName(rules.best_quotes(open_).select(F.col("key").alias("id"), "quote"))

    # Claims, proof, prediction

    def required_evidence(self, required: DataFrame, claim_type: str) -> DataFrame:
        """What a claim type (in any form of its name) requires, critical items first. Table: required (claim_type, evidence_id, is_critical)."""
        wanted = required.sparkSession.range(1).select(tx.claim_type(F.lit(claim_type), d.CLAIM_TYPES, d.CLAIM_FRAGMENTS).alias("claim_type"))
        same = tx.claim_type(F.col("claim_type"), d.CLAIM_TYPES, d.CLAIM_FRAGMENTS).alias("claim_type")
        return required.withColumn("claim_type", same).join(F.broadcast(wanted), "claim_type").orderBy(F.desc("is_critical"), "evidence_id")  # one row

    def proof_chain(self, required: DataFrame, *claims: str) -> DataFrame:
        """The chains of some claims, with the ids of satisfied and of missing evidence."""
        return self._described(required, F.col("id").isin(*claims))

    def document_chains(self, required: DataFrame, document: str) -> DataFrame:
        """The chains of the claims that were extracted from a document, which their ids say."""
        return self._described(required, F.col("id").startswith(f"legal_claim:doc:{document}:"))

    def _described(self, required: DataFrame, which) -> DataFrame:
        claims = self.entities.filter("type = 'legal_claim'").filter(which).select(F.col("id").alias("claim"), "claim_type")
        matched = proof.satisfied_by_name(claims, required, graph.hop(self.edges, "HAS_EVIDENCE", "claim", "evidence_id"))
        ids = lambda on: F.array_sort(F.collect_list(F.when(on, F.col("evidence_id"))))
        items = matched.groupBy("claim").agg(ids(F.col("satisfied")).alias("presented"), ids(~F.col("satisfied")).alias("missing"))
        outcomes = graph.hop(self.edges, "RESULTS_IN", "claim", "outcome").groupBy("claim").agg(F.min("outcome").alias("outcome"))
        return proof.with_totals(proof.chains(matched), claims, self.laws(), self.remedies(), outcomes).join(items, "claim", "left")

    def analyze(self, cases: DataFrame, required: DataFrame, top: int = 3) -> DataFrame:
        """For each situation (case_id, text) its likely claim types with what each requires and whether the text shows it.

        case_id, claim_type, score, n_required, n_satisfied, missing, completeness, strength, laws, outcome, probability. A claim type is
        likely if its words occur; evidence is shown if its name does. Table: required (claim_type, evidence_id, name, is_critical).
        """
        from pyspark.sql import Window

        low = F.concat(F.lit(" "), F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
        words = required.sparkSession.createDataFrame([(k, w) for k, ws in d.QUERY_CLAIMS.items() for w in ws], "claim_type string, word string")
        said = cases.select("case_id", low.alias("said"))
        hits = said.crossJoin(F.broadcast(words)).filter(F.contains("said", F.lower("word"))).groupBy("case_id", "claim_type").agg(F.count_distinct("word").alias("hits"))  # a fixed dictionary
        rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("hits"), "claim_type"))
        likely = hits.withColumn("rank", rank).filter(F.col("rank") <= top).select("case_id", "claim_type", F.least(F.lit(0.9), 0.5 + 0.1 * F.col("hits")).alias("score"))
        shown = F.contains("said", F.concat(F.lit(" "), F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))
        met = likely.join(required, "claim_type", "left").join(said, "case_id").withColumn("satisfied", F.coalesce(shown, F.lit(False)))
        done, there = F.col("satisfied").cast("int"), F.col("evidence_id").isNotNull()
        out = met.groupBy("case_id", "claim_type", "score").agg(
            F.count_if(there).alias("n_required"), F.count_if("satisfied").alias("n_satisfied"), F.array_sort(F.collect_list(F.when(there & ~F.col("satisfied"), F.col("name")))).alias("missing"),
            F.coalesce(proof.completeness(F.col("is_critical"), F.when(there, done)), F.lit(0.0)).alias("completeness"),
        )
        laws = self.laws().groupBy("claim_type").agg(F.array_sort(F.collect_list("law")).alias("laws"))
        return out.withColumn("strength", proof.strength(F.col("completeness"))).join(laws, "claim_type", "left").join(self.predictions().select("claim_type", "outcome", "probability"), "claim_type", "left")

    def claim_types(self) -> DataFrame:
        return self.entities.filter("type = 'legal_claim' and claim_type is not null").groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"))

    def laws(self, top: int = 8) -> DataFrame:
        return graph.laws_for_claims(self.entities, self.edges, top)

    def remedies(self, top: int = 6) -> DataFrame:
        return graph.remedies_for_claims(self.entities, self.edges, None, top)

    def proof_chains(self, required: DataFrame) -> DataFrame:
        """A chain for every claim, given what claim types require (claim_type, evidence_id, is_critical)."""
        claims = self.entities.filter("type = 'legal_claim'").select(F.col("id").alias("claim"), "claim_type")
        matched = proof.satisfied_by_name(claims, required, graph.hop(self.edges, "HAS_EVIDENCE", "claim", "evidence_id"))
        outcomes = graph.hop(self.edges, "RESULTS_IN", "claim", "outcome").groupBy("claim").agg(F.min("outcome").alias("outcome"))
        return proof.with_totals(proof.chains(matched), claims, self.laws(), self.remedies(), outcomes)

    def next_steps(self, required: DataFrame, top: int = 10) -> DataFrame:
        claims = self.entities.filter("type = 'legal_claim'").select(F.col("id").alias("claim"), "claim_type")
        matched = proof.satisfied_by_name(claims, required, graph.hop(self.edges, "HAS_EVIDENCE", "claim", "evidence_id"))
        best = graph.first_per(self.remedies(), ["claim_type"], [F.desc("citations"), "remedy"]).select("claim_type", "remedy")
        return proof.next_steps(proof.chains(matched).join(best, "claim_type", "left"), matched.filter("not satisfied"), top)

    def predictions(self) -> DataFrame:
        """claim_type, n, outcome, probability from the cases that address claims of the type."""
        cases = self.entities.filter("type = 'case_document'").select(F.col("id").alias("case"), F.col("outcome").alias("o"))
        claims = self.entities.filter("type = 'legal_claim'").select(F.col("id").alias("claim"), "claim_type")
        met = graph.hop(self.edges, "ADDRESSES", "case", "claim").join(cases, "case").join(claims, "claim")
        stats = met.groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"), F.avg(predict.favourable(F.col("o")).cast("int")).alias("rate"))
        outcome, p = predict.prediction(F.col("n"), F.col("rate"), F.lit("moderate"))
        return stats.select("claim_type", "n", outcome.alias("outcome"), p.alias("probability"))

    def relevance(self, texts: DataFrame) -> DataFrame:
        """texts (id, text) with struct r<relevant, confidence, matched>."""
        return texts.withColumn("r", rules.relevance("text"))

    # Maintenance and audit

    def consolidate(self, least: float = 0.95) -> tuple[Engine, DataFrame]:
        """(engine, moved): entities whose names' words are all but equal merged, edges rewired."""
        moved = dedup.resolved(dedup.greedy_merges(dedup.token_pairs(self.entities, least)))
        met = moved.select(F.explode(F.array("old", "new")).alias("id")).distinct()
        both = dedup.merged(self.entities.join(met, "id", "left_semi"), moved).select(*self.entities.columns)
        kept = self.entities.join(met, "id", "left_anti").unionByName(both)
        return Engine(kept, graph.remap_edges(self.edges, moved), self.chunks), moved

    def audit(self) -> dict[str, DataFrame]:
        return {
            "entities": audit.by_type(self.entities), "edges": audit.by_type(self.edges), "orphans": audit.orphans(self.entities, self.edges), "claims": audit.claim_completeness(self.entities, self.edges),
            "duplicates": audit.duplicate_names(self.entities), "insights": audit.insights(self.entities, self.edges),
        }

    def retrieval_metrics(self, ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
        return evaluate.retrieval_metrics(ranked, relevant, k)
