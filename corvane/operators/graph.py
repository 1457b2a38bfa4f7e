"""Undirected knowledge graphs as two tables: building, merging and walking them.

Edges are stored once, endpoints in lexical order.  Neighbourhoods use a table with both
directions, so every step is an equi-join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_keywords, keyword_parts, merged_csv, merged_lists, normal_key, relation_id, split_values

MAX_ENDPOINT = 256
#: Chunks that are taken off by a filter; more are joined.
LITERALS = 10_000


def canonical_edges(edges: DataFrame, src: str = "src_id", tgt: str = "tgt_id") -> DataFrame:
    """Edges with endpoints in order and the relation's id.  Loops are dropped; endpoints that are too long are an error."""
    a, b = F.col(src), F.col(tgt)
    long = (F.char_length(a) > MAX_ENDPOINT) | (F.char_length(b) > MAX_ENDPOINT)
    checked = F.when(long, F.raise_error(F.lit("an endpoint is too long")).cast("string")).otherwise(F.least(a, b))
    rest = [c for c in edges.columns if c not in (src, tgt, "id")]
    return edges.where(a != b).select(relation_id(a, b).alias("id"), checked.alias("src_id"), F.greatest(a, b).alias("tgt_id"), *rest)


def both_ways(relations: DataFrame) -> DataFrame:
    """entity_id, neighbour_id, relation_id in both directions."""
    one = relations.select(F.col("src_id").alias("entity_id"), F.col("tgt_id").alias("neighbour_id"), F.col("id").alias("relation_id"))
    two = relations.select(F.col("tgt_id").alias("entity_id"), F.col("src_id").alias("neighbour_id"), F.col("id").alias("relation_id"))
    return one.unionAll(two)


def adjacent(relations: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """Relations of each of entity_ids (one column, entity_id): entity_id, position by relation id, relation_id, neighbour_id."""
    near = both_ways(relations).join(entity_ids.select("entity_id").distinct(), "entity_id")
    pos = F.row_number().over(Window.partitionBy("entity_id").orderBy("relation_id"))
    return near.withColumn("position", pos)


def merge_relations(mentions: DataFrame) -> DataFrame:
    """One relation for each pair of endpoints from mentions in order of `pos`.

    mentions: src, tgt, keywords, description, weight, chunk_id, pos.  Keywords are the first
    mention's in canonical form and then each other's as they come, once each; the first description
    that is not empty; the largest weight; all chunks in order.
    """
    a, b = normal_key("src"), normal_key("tgt")
    named = mentions.where(a != b).select(
        F.least(a, b).alias("src_id"), F.greatest(a, b).alias("tgt_id"),
        F.struct("pos", "keywords", "description", "weight", "chunk_id").alias("m"),
    )
    grouped = named.groupBy("src_id", "tgt_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    first = canonical_keywords(F.col("m")[0]["keywords"])
    later = F.flatten(F.transform("m", lambda m: keyword_parts(F.coalesce(m["keywords"], F.lit("")))))
    described = F.filter(F.transform("m", lambda m: F.coalesce(m["description"], F.lit(""))), lambda d: d != "")
    return grouped.select(
        relation_id("src_id", "tgt_id").alias("id"), "src_id", "tgt_id",
        F.array_join(F.array_distinct(F.concat(keyword_parts(first), later)), ", ").alias("keywords"),
        F.coalesce(F.try_element_at(described, F.lit(1)), F.lit("")).alias("description"),
        F.array_max(F.transform("m", lambda m: F.coalesce(m["weight"], F.lit(1.0)))).alias("weight"),
        F.array_distinct(F.transform("m", lambda m: m["chunk_id"])).alias("source_chunk_ids"),
        F.array().cast("array<string>").alias("file_paths"),
    )


def missing_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Endpoints of relations that no entity has, as entities without type and description, with the relations' chunks."""
    ends = relations.select(F.explode(F.array("src_id", "tgt_id")).alias("id"), "source_chunk_ids")
    absent = ends.join(entities.select("id"), "id", "left_anti")
    chunks = absent.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunk_ids")))).alias("source_chunk_ids"))
    none = F.array().cast("array<string>")
    return chunks.select("id", F.col("id").alias("name"), F.lit("").alias("type"), F.lit("").alias("description"), none.alias("aliases"), "source_chunk_ids")


def clean_weight(weight, confidence):
    """weight, or else confidence, as a number within 0 and 1; 1 where neither is a number."""
    number = F.coalesce(weight.try_cast("double"), confidence.try_cast("double"))
    return F.coalesce(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), F.lit(1.0))


def merge_gleaned_entities(mentions: DataFrame) -> DataFrame:
    """chunk_id, name: all aliases, the longest description (the first of equal length), the first type that is not blank."""
    m = mentions.groupBy("chunk_id", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "description", "aliases"))).alias("m"))
    types = F.filter(F.transform("m", lambda x: F.coalesce(x["type"], F.lit(""))), lambda t: F.trim(t) != "")
    longest = F.array_max(F.transform("m", lambda x: F.struct(F.char_length(F.coalesce(x["description"], F.lit(""))).alias("n"), (-x["pos"]).alias("p"), F.coalesce(x["description"], F.lit("")).alias("d"))))
    return m.select(
        "chunk_id", "name", F.coalesce(F.try_element_at(types, F.lit(1)), F.lit("")).alias("type"), longest["d"].alias("description"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x["aliases"], F.array().cast("array<string>"))))).alias("aliases"),
    )


def merge_gleaned_relations(mentions: DataFrame) -> DataFrame:
    """One relation for each unordered pair and canonical keywords in a chunk, with the largest weight."""
    a, b = normal_key("src"), normal_key("tgt")
    key = mentions.select("chunk_id", F.least(a, b).alias("src_id"), F.greatest(a, b).alias("tgt_id"), canonical_keywords("keywords").alias("keywords"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return key.groupBy("chunk_id", "src_id", "tgt_id", "keywords").agg(F.max("weight").alias("weight"))


def drop_conflicting_aliases(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without aliases that equal their name, or that a relation names as the other end.

    entities: document_id, name, aliases; relations: document_id, src, tgt.
    """
    a, b = normal_key("src"), normal_key("tgt")
    pairs = relations.select("document_id", F.explode(F.array(F.struct(a.alias("n"), b.alias("o")), F.struct(b.alias("n"), a.alias("o")))).alias("p"))
    partners = pairs.groupBy("document_id", F.col("p.n").alias("__n")).agg(F.collect_set("p.o").alias("__partners"))
    joined = entities.withColumn("__n", normal_key("name")).join(partners, ["document_id", "__n"], "left")
    bad = F.coalesce("__partners", F.array().cast("array<string>"))
    kept = F.filter("aliases", lambda x: (normal_key(x) != F.col("__n")) & ~F.array_contains(bad, normal_key(x)) & (normal_key(x) != ""))
    return joined.withColumn("aliases", kept).drop("__n", "__partners")


# --- assembling a document's graph, in order ---------------------------------------------------------


class Mention(NamedTuple):
    """What one chunk says of an entity."""

    chunk: str
    name: str
    kind: str
    description: str
    aliases: tuple[str, ...]

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys(map(_key, (self.name, *self.aliases))))


def _key(name: str | None) -> str:
    return (name or "").strip().lower()


@lru_cache(4096)
def _parts(text: str) -> tuple[str, ...]:
    return tuple(p for p in (re.sub(r"[\s_-]+", "_", x.strip()) for x in text.split(",")) if p)


class KeyTable:
    """Which group of mentions holds a key; a guard keeps keys apart that a relation names as its two ends.

    A group is known by its first name's key.  If the guard keeps a mention of that very name out, a new group takes the old one's place.
    """

    def __init__(self, apart: set[frozenset[str]]):
        self.apart = apart
        self.holder: dict[str, str] = {}
        self.keys: dict[str, list[str]] = {}
        #: The groups' mentions in the order in which they joined, each with the names it adds.
        self.said: dict[str, list[tuple[Mention, list[str]]]] = {}

    def joins(self, keys: list[str], group: str) -> bool:
        return not any(frozenset((a, b)) in self.apart for a in keys for b in self.keys[group] if a != b)

    def _found(self, own: str, keys: list[str]) -> str:
        self.said[own], self.keys[own] = [], keys
        return own

    def add(self, m: Mention) -> None:
        """Unite the mention with all groups that hold one of its keys, unless the guard objects."""
        keys = m.keys
        met = [g for g in dict.fromkeys(self.holder[k] for k in keys if k in self.holder) if self.joins(keys, g)]
        home = met[0] if met else self._found(_key(m.name), [])
        for g in met[1:]:
            self.said[home] += self.said.pop(g)
            self.keys[home] += self.keys.pop(g)
        self.said[home].append((m, [x for x in ([m.name] * bool(met) + [*m.aliases]) if _key(x) != home]))
        self.keys[home] = list(dict.fromkeys([*self.keys[home], *keys]))
        self.holder.update(dict.fromkeys(self.keys[home], home))

    def see(self, chunk: str, name: str) -> str:
        """The group of a relation's end, which the chunk mentions by this; a new one if none holds the name."""
        k = _key(name)
        group = self.holder.setdefault(k, k)
        if group not in self.said:
            self._found(group, [k])
        self.said[group].append((Mention(chunk, name, "", "", ()), []))
        return group

    def fold(self, group: str) -> dict:
        """One entity of a group: the first name, type and description, each alias once, all chunks."""
        said = self.said[group]
        aliases: dict[str, str] = {}
        for x in (x for _, names in said for x in names if _key(x) not in ("", group)):
            aliases.setdefault(_key(x), x.strip())
        first = lambda values: next(filter(None, values), "")
        return {
            "id": group, "name": said[0][0].name, "type": first(m.kind for m, _ in said), "description": first(m.description for m, _ in said),
            "aliases": list(aliases.values()), "source_chunk_ids": list(dict.fromkeys(m.chunk for m, _ in said)),
        }


def _edge(pair: tuple[str, str], said: list[tuple[str, dict]]) -> dict:
    """One relation of all that chunks say of a pair: the first description, the largest weight, each keyword once."""
    words = [r["keywords"] or "" for _, r in said]
    keywords = dict.fromkeys([*sorted(set(_parts(_key(words[0])))), *(p for w in words for p in _parts(w))])
    return {
        "src_id": pair[0], "tgt_id": pair[1], "keywords": ", ".join(keywords), "description": next(filter(None, (r["description"] for _, r in said)), ""),
        "weight": max(1.0 if r["weight"] is None else r["weight"] for _, r in said), "source_chunk_ids": list(dict.fromkeys(c for c, _ in said)),
    }


def assemble(extractions: pd.DataFrame) -> tuple[list[dict], list[dict]]:
    """One document's graph from its chunks' extractions, in order.

    Entities that share a name or an alias become one, unless a relation names the two keys as its
    ends.  The first spelling, type and description win; ends that no entity has are added.
    """
    rows = extractions.sort_values(["chunk_order", "chunk_id"])
    table, said = assembled(list(zip(rows["chunk_id"], rows["entities"], rows["relations"])))
    return [table.fold(g) for g in table.said], [_edge(pair, own) for pair, own in said.items()]


def assembled(rows: list[tuple]) -> tuple[KeyTable, dict[tuple[str, str], list]]:
    """The groups of a document's names, and what is said of each pair of them, from (chunk_id, entities, relations) in order."""
    relations = [(chunk, r) for chunk, _, own in rows for r in own]
    ends = [(_key(r["source"]), _key(r["target"])) for _, r in relations]
    table = KeyTable({frozenset(e) for e in ends if all(e) and e[0] != e[1]})
    for chunk, own, _ in rows:
        for x in own:
            aliases = x["aliases"] if x["aliases"] is not None else []
            told = tuple(a for a in aliases if _key(a) and frozenset((_key(x["name"]), _key(a))) not in table.apart)
            table.add(Mention(chunk, x["name"], x["type"] or "", x["description"] or "", told))
    said: dict[tuple[str, str], list] = {}
    for chunk, r in relations:
        a, b = (table.see(chunk, r[end]) for end in ("source", "target"))
        if a != b:
            said.setdefault((min(a, b), max(a, b)), []).append((chunk, r))
    return table, said


_NODE = "id:string,name:string,type:string,description:string,aliases:array<string>,source_chunk_ids:array<string>"
_EDGE = "src_id:string,tgt_id:string,keywords:string,description:string,weight:double,source_chunk_ids:array<string>"


_STRINGS = pa.list_(pa.string())
_ARROW = {
    "entities": pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("type", pa.string()), ("description", pa.string()), ("aliases", _STRINGS), ("source_chunk_ids", _STRINGS)])),
    "relations": pa.list_(pa.struct([("src_id", pa.string()), ("tgt_id", pa.string()), ("keywords", pa.string()), ("description", pa.string()), ("weight", pa.float64()), ("source_chunk_ids", _STRINGS)])),
}
#: Rows that become Python objects at a time, and entities and relations that go out at a time.
SLICE, ITEMS = 256, 20_000


def assemble_documents(extractions: DataFrame, parts: tuple[str, ...] = ("entities", "relations")) -> DataFrame:
    """document_id, entities, relations (or one of them): each document's graph, assembled once.  A document's extractions must fit into a task."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
        name, own = None, []
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                for r in batch.slice(a, SLICE).to_pylist():
                    if r["place"] == 1 and own:
                        yield name, own
                        own = []
                    name = r["document_id"]
                    own.append((r["chunk_id"], r["entities"] or [], r["relations"] or []))
        if own:
            yield name, own

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), *(_ARROW[p] for p in parts)])], ["document_id", *parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for name, own in documents(batches):
            table, said = assembled(own)
            graph = {"entities": lambda: [table.fold(g) for g in table.said], "relations": lambda: [_edge(pair, x) for pair, x in said.items()]}
            out.append((name, *(graph[p]() for p in parts)))
            n += sum(map(len, out[-1][1:]))
            if n >= ITEMS:
                yield pack(out)
                out, n = [], 0
        if out:
            yield pack(out)

    # the window leaves each document's rows together and in order, so tasks run through all of theirs in one go
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.asc_nulls_last("chunk_order"), F.asc_nulls_last("chunk_id")))
    types = {"entities": f"array<struct<{_NODE}>>", "relations": f"array<struct<{_EDGE}>>"}
    rows = extractions.select("document_id", "chunk_id", "entities", "relations", place.alias("place"))
    return rows.mapInArrow(run, ", ".join(["document_id string", *(f"{p} {types[p]}" for p in parts)]))


def entities_of(documents: DataFrame) -> DataFrame:
    """document_id and the entities of assembled documents."""
    return documents.select("document_id", F.inline("entities"))


def relations_of(documents: DataFrame) -> DataFrame:
    """document_id and the relations of assembled documents."""
    found = documents.select("document_id", F.inline("relations"))
    return found.select("document_id", relation_id("src_id", "tgt_id").alias("id"), "src_id", "tgt_id", "keywords", "description", "weight", "source_chunk_ids", F.array().cast("array<string>").alias("file_paths"))


def assemble_entities(extractions: DataFrame) -> DataFrame:
    """document_id and the entities of each document's graph."""
    return entities_of(assemble_documents(extractions, ("entities",)))


def assemble_relations(extractions: DataFrame) -> DataFrame:
    """document_id and the relations of each document's graph."""
    return relations_of(assemble_documents(extractions, ("relations",)))


# --- merging into what is stored --------------------------------------------------------------------


def upsert_entities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored type and description stay unless empty; aliases and chunks are united, stored ones first."""
    s, n = stored.alias("s"), incoming.alias("n")
    pick = lambda c: F.coalesce(F.when(F.col(f"s.{c}") != "", F.col(f"s.{c}")), F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c)
    return s.join(n, F.col("s.id") == F.col("n.id"), "full").select(
        F.coalesce("s.id", "n.id").alias("id"), F.coalesce("s.name", "n.name").alias("name"), pick("type"), pick("description"),
        merged_lists("s.aliases", "n.aliases").alias("aliases"), merged_lists("s.source_chunk_ids", "n.source_chunk_ids").alias("source_chunk_ids"),
    )


def upsert_relations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """As upsert_entities; stored keywords stay, and the larger weight holds."""
    s, n = stored.alias("s"), incoming.alias("n")
    keep = lambda c: F.coalesce(F.when(F.col(f"s.{c}") != "", F.col(f"s.{c}")), F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c)
    both = lambda c: F.coalesce(f"s.{c}", f"n.{c}").alias(c)
    return s.join(n, F.col("s.id") == F.col("n.id"), "full").select(
        both("id"), both("src_id"), both("tgt_id"), both("keywords"), keep("description"), F.greatest("s.weight", "n.weight").alias("weight"),
        merged_lists("s.source_chunk_ids", "n.source_chunk_ids").alias("source_chunk_ids"), merged_lists("s.file_paths", "n.file_paths").alias("file_paths"),
    )


def resolve_names(entities: DataFrame, names: DataFrame) -> DataFrame:
    """name, id, problem: an entity's own name wins, else the only entity with that alias; problem says why there is none."""
    asked = names.select("name", normal_key("name").alias("k")).distinct()
    own = entities.select(normal_key("name").alias("k"), F.col("id").alias("own"))
    other = entities.select(F.explode("aliases").alias("a"), "id").groupBy(normal_key("a").alias("k")).agg(F.min("id").alias("alias_of"), F.countDistinct("id").alias("n"))
    found = asked.join(own, "k", "left").join(other, "k", "left")
    problem = F.when(F.col("own").isNotNull() | (F.col("n") == 1), F.lit(None)).when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return found.select("name", F.coalesce("own", F.when(F.col("n") == 1, F.col("alias_of"))).alias("id"), problem.alias("problem"))


# --- managing --------------------------------------------------------------------------------------


def fold_relations(relations: DataFrame) -> DataFrame:
    """Relations of equal ends folded: united keywords, descriptions by blank lines, largest weight, united chunks; loops dropped."""
    a, b = F.least("src_id", "tgt_id"), F.greatest("src_id", "tgt_id")
    m = relations.where("src_id <> tgt_id").select(a.alias("src_id"), b.alias("tgt_id"), F.struct("id", "keywords", "description", "weight", "source_chunk_ids", "file_paths").alias("m"))
    g = m.groupBy("src_id", "tgt_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    words = F.aggregate(F.transform("m", lambda x: x["keywords"]), F.lit(""), merged_csv)
    texts = F.array_distinct(F.filter(F.transform("m", lambda x: F.trim(F.coalesce(x["description"], F.lit("")))), lambda d: d != ""))
    return g.select(
        relation_id("src_id", "tgt_id").alias("id"), "src_id", "tgt_id", words.alias("keywords"), F.array_join(texts, "\n\n").alias("description"),
        F.array_max(F.transform("m", lambda x: x["weight"])).alias("weight"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["source_chunk_ids"]))).alias("source_chunk_ids"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["file_paths"]))).alias("file_paths"),
    )


def rename_ends(relations: DataFrame, renamed: DataFrame) -> DataFrame:
    """Relations whose ends are renamed by a table (old, new), folded where they meet."""
    r = relations.join(renamed.select(F.col("old").alias("src_id"), F.col("new").alias("__s")), "src_id", "left")
    r = r.join(renamed.select(F.col("old").alias("tgt_id"), F.col("new").alias("__t")), "tgt_id", "left")
    return fold_relations(r.withColumn("src_id", F.coalesce("__s", "src_id")).withColumn("tgt_id", F.coalesce("__t", "tgt_id")).drop("__s", "__t"))


def merge_entities(entities: DataFrame, relations: DataFrame, sources: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Entities with `sources` (one column, id) merged into the target, and relations redirected to it."""
    old = sources.select("id").where(F.col("id") != target).distinct()
    merged = entities.join(old, "id", "left_semi").select(F.lit(target).alias("id"), F.struct("id", "name", "description", "aliases", "source_chunk_ids").alias("m"))
    g = merged.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    into = entities.join(old, "id", "left_anti").join(g, "id", "left")
    names = F.flatten(F.transform("m", lambda x: F.concat(F.array(x["name"]), x["aliases"])))
    texts = F.filter(F.concat(F.array("description"), F.transform("m", lambda x: x["description"])), lambda d: F.trim(F.coalesce(d, F.lit(""))) != "")
    is_target = F.col("m").isNotNull()
    done = into.select(
        "id", "name", "type", F.when(is_target, F.array_join(F.array_distinct(texts), "\n\n")).otherwise(F.col("description")).alias("description"),
        F.when(is_target, F.filter(merged_lists("aliases", names), lambda x: normal_key(x) != normal_key("name"))).otherwise(F.col("aliases")).alias("aliases"),
        F.when(is_target, merged_lists("source_chunk_ids", F.flatten(F.transform("m", lambda x: x["source_chunk_ids"])))).otherwise(F.col("source_chunk_ids")).alias("source_chunk_ids"),
    )
    return done, rename_ends(relations, old.select(F.col("id").alias("old"), F.lit(target).alias("new")))


def delete_entities(entities: DataFrame, relations: DataFrame, vectors: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without all entities that have one of `names` as name or alias, their relations, and both's vectors."""
    asked = names.select(normal_key("name").alias("__k")).distinct()
    keys = entities.select("id", F.explode(F.array_union(F.array("name"), "aliases")).alias("__a")).select("id", normal_key("__a").alias("__k"))
    gone = keys.join(asked, "__k", "left_semi").select("id").distinct()
    rest = relations.join(gone.select(F.col("id").alias("src_id")), "src_id", "left_anti").join(gone.select(F.col("id").alias("tgt_id")), "tgt_id", "left_anti").select(*relations.columns)
    lost = gone.select(F.lit("entities").alias("namespace"), "id").unionByName(relations.select("id").join(rest.select("id"), "id", "left_anti").select(F.lit("relations").alias("namespace"), "id"))
    return entities.join(gone, "id", "left_anti"), rest, vectors.join(lost, ["namespace", "id"], "left_anti")


def delete_relation(relations: DataFrame, vectors: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Without the relation of two entities, in either direction, and its vector."""
    ends = (F.col("src_id") == min(a, b)) & (F.col("tgt_id") == max(a, b))
    gone = relations.where(ends).select(F.lit("relations").alias("namespace"), "id")
    return relations.where(~ends), vectors.join(gone, ["namespace", "id"], "left_anti")


def without_chunks(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that lose some chunks (one column, id), and go when none are left or an end is gone."""
    lost = chunks.select(F.col("id").alias("c"))
    some = [r.c for r in lost.where("c IS NOT NULL").limit(LITERALS + 1).collect()]

    def without(rows: DataFrame) -> DataFrame:
        if len(some) <= LITERALS:  # rows stay where they are
            left = F.filter("source_chunk_ids", lambda c: ~F.coalesce(c.isin(some), F.lit(False)))
            kept = rows.where(F.col("source_chunk_ids").isNull() | (F.size("source_chunk_ids") == 0) | (F.size(left) > 0))
            return kept.withColumn("source_chunk_ids", left).select(*rows.columns)
        hit = rows.select("id", F.posexplode("source_chunk_ids").alias("pos", "c")).join(lost, "c", "left_semi").select("id").distinct()
        # only rows that hold one of the chunks are taken apart
        touched = rows.join(hit, "id", "left_semi").select("id", F.posexplode("source_chunk_ids").alias("pos", "c")).join(lost, "c", "left_anti")
        left = touched.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("__left"))
        marked = rows.join(hit.withColumn("__hit", F.lit(True)), "id", "left").join(left, "id", "left")
        kept = marked.where(F.col("__hit").isNull() | F.col("__left").isNotNull())
        return kept.withColumn("source_chunk_ids", F.coalesce("__left", "source_chunk_ids")).select(*rows.columns)

    nodes = without(entities)
    ends = nodes.select("id")
    edges = without(relations).join(ends.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(ends.select(F.col("id").alias("tgt_id")), "tgt_id", "left_semi").select(*relations.columns)
    return nodes, edges


def delete_documents(chunks: DataFrame, entities: DataFrame, relations: DataFrame, vectors: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Without the chunks of some documents (one column, document_id); entities and relations lose them."""
    gone = documents.select("document_id").distinct()
    nodes, edges = without_chunks(entities, relations, chunks.join(gone, "document_id", "left_semi").select("id"))
    rest = chunks.join(gone, "document_id", "left_anti").select(*chunks.columns)
    alive = rest.select(F.lit("chunks").alias("namespace"), "id").unionByName(nodes.select(F.lit("entities").alias("namespace"), "id")).unionByName(edges.select(F.lit("relations").alias("namespace"), "id"))
    return {"chunks": rest, "entities": nodes, "relations": edges, "vectors": vectors.join(alive, ["namespace", "id"], "left_semi")}


def delete_document(chunks: DataFrame, entities: DataFrame, relations: DataFrame, vectors: DataFrame, document_id: str) -> dict[str, DataFrame]:
    """Without one document's chunks."""
    return delete_documents(chunks, entities, relations, vectors, chunks.sparkSession.createDataFrame([(document_id,)], "document_id string"))


def expand_ids(joined: DataFrame, column: str = "source_id") -> DataFrame:
    """Rows with a separator-joined list of ids, one for each id."""
    return joined.withColumn(column, F.explode(split_values(column)))


