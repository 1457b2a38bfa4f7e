"""Extraction of entities and relations by a model, its parsing, gaps and refinement."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EXTRACTION

#: Constants of gleaning and refinement windows.
GLEANINGS, MAX_INPUT_TOKENS, MAX_WINDOW_CHUNKS, MAX_WINDOW_CHARS, WINDOWS_PER_DOCUMENT = 1, 20_480, 3, 1200, 1
#: Words at a text's end that promise a relation.
OPEN_ENDINGS = ("依赖", "通过", "使用", "调用", "用于", "先", "再")
PROMPT = (
    "List the entities and relations of the text as JSON: {\"entities\": [{\"name\", \"type\", \"description\", \"aliases\"}], "
    "\"relations\": [{\"source\", \"target\", \"keywords\", \"description\", \"weight\"}]}.\nText:\n"
)


def json_object(response: str) -> dict:
    """The object of a model's answer: a whole fenced block, the first fenced block, or the first balanced object."""
    text = response.strip()
    tries = [m.group(1) for m in re.finditer(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)] or []
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth, quoted, escaped = 0, False, False
        for i, c in enumerate(text[start:], start):
            if quoted:
                quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    tries.append(text[start : i + 1])
                    break
        break
    for t in [text, *tries]:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("the answer holds no JSON object")


def _weight(r: dict) -> float:
    for k in ("weight", "confidence"):
        try:
            return min(1.0, max(0.0, float(r[k])))
        except (KeyError, TypeError, ValueError):
            continue
    return 1.0


def parse_extraction(response: str) -> tuple[list[dict], list[dict]]:
    """Entities and relations of a model's answer; items without names are left out."""
    found = json_object(response)
    s = lambda x: x.strip() if isinstance(x, str) else ""
    entities = [{"name": s(e.get("name")), "type": s(e.get("type")), "description": s(e.get("description")), "aliases": [a.strip() for a in e.get("aliases") or [] if isinstance(a, str) and a.strip()]} for e in found.get("entities") or [] if isinstance(e, dict) and s(e.get("name"))]
    relations = []
    for r in found.get("relations") or []:
        if isinstance(r, dict):
            a, b = s(r.get("source") or r.get("sourceEntityName")), s(r.get("target") or r.get("targetEntityName"))
            if a and b:
                relations.append({"source": a, "target": b, "keywords": s(r.get("keywords") or r.get("type")) or "related_to", "description": s(r.get("description")), "weight": _weight(r)})
    return entities, relations


def merge_gleaned(base: tuple[list, list], more: tuple[list, list]) -> tuple[list, list]:
    """Entities by name: aliases united, the longer description, the first type.  Relations by pair and keywords: the larger weight."""
    from .graph import _key, _parts

    entities = {e["name"]: dict(e) for e in base[0]}
    for e in more[0]:
        old = entities.get(e["name"])
        if old is None:
            entities[e["name"]] = dict(e)
            continue
        old["aliases"] = list(dict.fromkeys([*old["aliases"], *e["aliases"]]))
        old["type"] = old["type"] or e["type"]
        old["description"] = e["description"] if len(e["description"]) > len(old["description"]) else old["description"]
    key = lambda r: (*sorted((_key(r["source"]), _key(r["target"]))), ",".join(sorted(set(_parts(_key(r["keywords"]))))))
    relations = {key(r): dict(r) for r in base[1]}
    for r in more[1]:
        old = relations.setdefault(key(r), dict(r))
        old["weight"] = max(old["weight"], r["weight"])
    return list(entities.values()), list(relations.values())


def extract(chunks: DataFrame, chat: Callable[[str], str], gleanings: int = GLEANINGS, most: int = MAX_INPUT_TOKENS) -> DataFrame:
    """Each chunk's extraction by the model, asked again for what it missed unless the text is too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                found = parse_extraction(chat(PROMPT + (r.text or "")))
                for _ in range(gleanings if len((r.text or "").split()) <= most else 0):
                    found = merge_gleaned(found, parse_extraction(chat(PROMPT + (r.text or "") + "\nAlready found: " + json.dumps([e["name"] for e in found[0]], ensure_ascii=False) + "\nOnly what is missing:")))
                out.append((r.document_id, r.id, r.chunk_order, *found))
            yield pd.DataFrame(out, columns=["document_id", "chunk_id", "chunk_order", "entities", "relations"])

    return chunks.select("document_id", "id", "text", "chunk_order").mapInPandas(run, EXTRACTION)


def has_gap(text: Column, entities: Column, relations: Column) -> Column:
    """The text breaks off where a relation was to come, and entities were found but no relation."""
    end = F.regexp_replace(text, r"\s+$", "")
    return F.greatest(*[F.endswith(end, F.lit(w)) for w in OPEN_ENDINGS]) & (F.size(entities) >= 2) & (F.size(relations) == 0)


def refinement_windows(extracted: DataFrame) -> DataFrame:
    """For the first gap of each document: document_id, chunk_ids and text of the chunk with its neighbours, if they are short enough.

    extracted: an extraction's columns and the chunk's text.
    """
    w = Window.partitionBy("document_id").orderBy("chunk_order", "chunk_id")
    one = F.struct("chunk_id", "text")
    near = extracted.withColumn("__w", F.filter(F.array(F.lag(one).over(w), one, F.lead(one).over(w)), lambda x: x.isNotNull())).where(has_gap(F.col("text"), F.col("entities"), F.col("relations")))
    text = F.array_join(F.transform("__w", lambda x: x["text"]), "\n")
    short = near.withColumn("window_text", text).where(F.char_length(F.regexp_replace("window_text", r"\s", "")) <= MAX_WINDOW_CHARS)
    first = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_order", "chunk_id"))
    return short.withColumn("__n", first).where(F.col("__n") <= WINDOWS_PER_DOCUMENT).select("document_id", "chunk_id", F.transform("__w", lambda x: x["chunk_id"]).alias("chunk_ids"), "window_text")


def attribute(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Refined relations given to chunks: by their indexes in the window, or else to those that hold both ends.

    items: document_id, chunk_ids, indexes, source, target, keywords, description, weight.
    """
    by_index = items.where(F.size("indexes") > 0).select("*", F.explode("indexes").alias("__i")).where((F.col("__i") >= 0) & (F.col("__i") < F.size("chunk_ids"))).withColumn("chunk_id", F.get("chunk_ids", F.col("__i"))).drop("__i")
    rest = items.where(F.coalesce(F.size("indexes"), F.lit(0)) <= 0).withColumn("chunk_id", F.explode("chunk_ids"))
    texts = chunks.select(F.col("id").alias("chunk_id"), F.lower("text").alias("__t"))
    held = rest.join(texts, "chunk_id").where(F.contains("__t", F.lower("source")) & F.contains("__t", F.lower("target"))).drop("__t")
    return by_index.unionByName(held).dropDuplicates(["document_id", "chunk_id", "source", "target", "keywords"])


def with_patches(extractions: DataFrame, patches: DataFrame) -> DataFrame:
    """Extractions with attributed relations added, ends that they lack as entities, larger weights for known ones."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples(index=False):
            found = (list(r.entities), list(r.relations))
            new = [{k: p[k] for k in ("source", "target", "keywords", "description", "weight")} for p in right[right["chunk_id"] == r.chunk_id].to_dict("records")]
            names = {e["name"].strip().lower() for e in found[0]}
            ends = [{"name": n, "type": "", "description": "", "aliases": []} for p in new for n in (p["source"], p["target"]) if n.strip().lower() not in names]
            found = merge_gleaned(([dict(e, aliases=list(e["aliases"])) for e in found[0]], [dict(x) for x in found[1]]), (ends, new))
            out.append((r.document_id, r.chunk_id, r.chunk_order, *found))
        return pd.DataFrame(out, columns=["document_id", "chunk_id", "chunk_order", "entities", "relations"])

    return extractions.groupBy("document_id").cogroup(patches.groupBy("document_id")).applyInPandas(run, EXTRACTION)


def refine(extracted: DataFrame, chunks: DataFrame, chat: Callable[[str], str]) -> DataFrame:
    """Extractions whose gaps were asked about again, with the chunks around them."""
    windows = refinement_windows(extracted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for x in parse_extraction(chat(PROMPT + r.window_text))[1]:
                    out.append((r.document_id, list(r.chunk_ids), [], x["source"], x["target"], x["keywords"], x["description"], x["weight"]))
            yield pd.DataFrame(out, columns=["document_id", "chunk_ids", "indexes", "source", "target", "keywords", "description", "weight"])

    found = windows.mapInPandas(run, "document_id string, chunk_ids array<string>, indexes array<int>, source string, target string, keywords string, description string, weight double")
    return with_patches(extracted.select("document_id", "chunk_id", "chunk_order", "entities", "relations"), attribute(found, chunks))


