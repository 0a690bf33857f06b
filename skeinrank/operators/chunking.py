"""Documents to chunks: the legal grammar (a state machine over lines, one document at a time) and
the chunk contract; for other documents, lines are fragments."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.readers import stored

# The markers of the grammar's levels, and the chunk limit in characters.
ARTICLE = re.compile(r"Art(?:igo)?\.?\s+(\d+)\s*[ºo°]?\s*(-[A-Z])?[\s.\-–]")
PARAGRAPH = re.compile(r"§\s*(\d+)")
SOLE = re.compile(r"par[áa]grafo\s+[úu]nico", re.IGNORECASE)
INCISO = re.compile(r"([IVXLCDM]+)\s*[-–—]\s+")
ALINEA = re.compile(r"([a-z])\)\s+")
HEADING = re.compile(r"(?:T[ÍI]TULO|CAP[ÍI]TULO|Se[çc][ãa]o|Subse[çc][ãa]o|ANEXO)\b")
LIMIT = 1800
#: Characters of joined texts that a task holds at a time, about.
HELD = 4_000_000

NODES = "norm_id string, node_ord int, kind string, ref string, parent_ord int, text string, headings array<string>"


#: Levels below an article, outermost first, each with what names a node of it.
LEVELS = [("paragraph", SOLE, lambda m: "par-unico"), ("paragraph", PARAGRAPH, lambda m: f"par-{m[1]}"), ("inciso", INCISO, lambda m: f"inc-{m[1].lower()}"), ("alinea", ALINEA, lambda m: f"ali-{m[1]}")]
DEPTH = {"article": 0, "paragraph": 1, "inciso": 2, "alinea": 3}


def parse(norm_id: str, text: str | None) -> list[tuple]:
    """Nodes in order. A repeated article adds its own line to the first one; headings add up and are never reset; an
    annex changes the names of the articles that follow, while what is open stays open."""
    nodes: list[list] = [[norm_id, 0, "preamble", f"{norm_id}::preamble", None, [], []]]
    first_of: dict[str, int] = {}
    headings: list[str] = []
    scope, annexes = "", 0
    open_: list[int] = []  # the article and the nodes below it that are open, outermost first

    def add(kind, ref, parent, line):
        nodes.append([norm_id, len(nodes), kind, ref, parent, [line], list(headings)])
        return len(nodes) - 1

    for line in (text or "").splitlines():
        line = line.strip()
        if not line:
            continue
        if HEADING.match(line):
            headings.append(line)
            if line.startswith("ANEXO"):
                annexes += 1
                scope = f"anexo-{re.sub('[^a-z0-9]+', '-', line[5:].strip().lower()).strip('-') or annexes}-"
            continue
        if m := ARTICLE.match(line):
            ref = f"{norm_id}::{scope}art-{m[1]}{(m[2] or '').lower()}"
            if ref in first_of:
                nodes[first_of[ref]][5].append(line)
            else:
                first_of[ref] = add("article", ref, None, line)
            open_ = [first_of[ref]]
            continue
        kind, label = next(((k, name(m)) for k, pattern, name in LEVELS if open_ and (m := pattern.match(line))), (None, None))
        if kind is None:
            nodes[open_[-1] if open_ else 0][5].append(line)
            continue
        while DEPTH[nodes[open_[-1]][2]] >= DEPTH[kind]:
            open_.pop()
        over = nodes[open_[-1]]
        open_.append(add(kind, over[3] + ("::" if over[2] == "article" else "-") + label, over[1], line))
    return [(*n[:5], "\n".join(n[5]).strip(), n[6]) for n in nodes if n[5]]


def parse_legal(docs: DataFrame) -> DataFrame:
    """docs(norm_id, text) to the adjacency table of nodes."""

    def run(frames):
        names = [c.split()[0] for c in NODES.split(", ")]
        for f in frames:
            yield pd.DataFrame([n for i, t in zip(f["norm_id"], f["text"]) for n in parse(i, t)], columns=names).astype({"parent_ord": "Int64"})

    return docs.select("norm_id", "text").mapInPandas(run, NODES)


CHUNKS = "norm_id string, chunk_ord int, chunk_id string, text string, structural_ids array<string>, parent_id string, role string, section string"


def chunks_of(nodes: list[tuple], limit: int) -> list[tuple]:
    """Of one document's nodes in order: the preamble, every article with all below it, and of articles over `limit`
    characters their direct parts, too."""
    below: dict[int, list[int]] = {}
    for n in nodes:
        if n[4] is not None:
            below.setdefault(n[4], []).append(n[1])
    at = {n[1]: n for n in nodes}

    def tree(o):
        return [o] + [x for c in below.get(o, []) for x in tree(c)]

    def whole(top, parent, role, section):
        own = tree(top)
        out.append((at[top][3], "\n".join(at[o][5] for o in own if at[o][5]), [at[o][3] for o in own], parent, role, section))

    out: list[tuple] = []
    for _, o, kind, ref, _, text, headings in nodes:
        if kind == "preamble":
            out.append((ref, text, [], None, "preamble", None))
        elif kind == "article":
            section = " > ".join(headings) or None
            whole(o, ref, "article", section)
            if len(out[-1][1]) > limit:
                for c in below.get(o, []):
                    whole(c, ref, "fragment", section)
    return [(nodes[0][0], i, *c) for i, c in enumerate(out)]


def chunk_legal(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs(norm_id, text) to chunks: parsed and cut in one pass over the documents, without a shuffle."""

    def run(frames):
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for f in frames:
            yield pd.DataFrame([c for i, t in zip(f["norm_id"], f["text"]) if (nodes := parse(i, t)) for c in chunks_of(nodes, limit)], columns=names)

    return docs.select("norm_id", "text").mapInPandas(run, CHUNKS)


def chunk_nodes(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`chunk_legal` of a stored table of nodes; a document's nodes meet in one group."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.norm_id, int(r.node_ord), r.kind, r.ref, None if pd.isna(r.parent_ord) else int(r.parent_ord), r.text, list(r.headings)) for r in f.sort_values("node_ord").itertuples()]
        return pd.DataFrame(chunks_of(rows, limit), columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return nodes.groupBy("norm_id").applyInPandas(run, CHUNKS)


def collisions(nodes: DataFrame) -> DataFrame:
    """References that several nodes share."""
    return nodes.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1")


def count_gate(nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose articles aren't as many as manifest(norm_id, expected) says; empty means passed."""
    return gate_faults(nodes.where("kind = 'article'").groupBy("norm_id").agg(F.count("*").alias("found")), manifest)


def gate_faults(found: DataFrame, manifest: DataFrame) -> DataFrame:
    both = manifest.where("expected is not null").join(found, "norm_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where("found <> expected")


def chunk_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, norm, text): the whole document as a chunk, and of one over `limit` characters every line that isn't blank."""
    whole = docs.select(F.concat_ws("::", "norm", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("parent"), F.coalesce("text", F.lit("")).alias("text"))
    lines = whole.where(F.length("text") > limit).select("parent", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    # a line's number counts blank lines, too: no sort of a document's lines is needed
    parts = lines.select(F.concat("parent", F.lit("::par-"), (F.col("pos") + 1).cast("string")).alias("chunk_id"), F.col("line").alias("text"), F.col("parent").alias("parent_id"), F.lit("fragment").alias("role"))
    return whole.select(F.col("parent").alias("chunk_id"), "text", F.col("parent").alias("parent_id"), F.lit("article").alias("role")).unionByName(parts)


def ingest(docs: DataFrame, manifest: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """docs(norm_id, text, source_hash), manifest(norm_id, expected): chunks with metadata, and the documents that
    fail the gate (an empty table means passed). A document without articles has none found, so it fails, too."""
    chunks = chunk_legal(docs, limit)
    faults = gate_faults(chunks.where("role = 'article'").groupBy("norm_id").agg(F.count("*").alias("found")), manifest)
    meta = F.map_filter(F.create_map(F.lit("norm"), F.col("norm_id"), F.lit("section"), F.col("section"), F.lit("source_hash"), F.col("source_hash")), lambda k, v: v.isNotNull())
    out = chunks.join(docs.select("norm_id", "source_hash"), "norm_id").withColumn("metadata", meta)
    return out.select("norm_id", "chunk_ord", "chunk_id", "text", "structural_ids", "parent_id", "role", "metadata"), faults


def corpus_text(nodes: DataFrame) -> DataFrame:
    """(ref, text) of a stored table of nodes: the text of each structural id with all below it; of ids that collide the last one holds."""
    up = nodes.select("norm_id", "node_ord", "parent_ord", "ref", "text")
    pairs = up.select("norm_id", F.col("node_ord").alias("top"), "node_ord", "text")
    level = up.where("parent_ord is not null").select("norm_id", F.col("parent_ord").alias("top"), "node_ord", "text")
    above = up.select("norm_id", F.col("node_ord").alias("top"), F.col("parent_ord").alias("next"))
    for _ in range(3):  # the grammar has four levels
        pairs = pairs.unionByName(level)
        level = level.join(above, ["norm_id", "top"]).where("next is not null").select("norm_id", F.col("next").alias("top"), "node_ord", "text")
    whole = pairs.groupBy("norm_id", "top").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    named = whole.join(up.select("norm_id", F.col("node_ord").alias("top"), "ref"), ["norm_id", "top"])
    return named.groupBy("ref").agg(F.max_by("text", "top").alias("text"))


def texts_of(nodes: list[tuple]) -> dict[str, str]:
    """Of one document's nodes in order: the text of each id with all below it; of ids that collide the last one holds."""
    over, held = {n[1]: n[4] for n in nodes}, {n[1]: [] for n in nodes}
    for n in nodes:
        o = n[1]
        while o is not None:
            held[o].append(n[5])
            o = over[o]
    return {n[3]: "\n".join(held[n[1]]) for n in nodes}


def legal_texts(docs: DataFrame) -> DataFrame:
    """`corpus_text` of docs(norm_id, text), whose ids mustn't repeat: parsed and joined in one pass over the documents, without a shuffle, as
    a reference's last part tells where its norm's id ends, so that references of two norms can't collide."""

    def run(batches):
        for batch in batches:
            refs, texts, size = [], [], 0
            for i, t in zip(batch["norm_id"].to_pylist(), batch["text"].to_pylist()):
                own = texts_of(parse(i, t))
                refs += own.keys()
                texts += own.values()
                size += sum(map(len, own.values()))
                if size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(texts, pa.string())], ["ref", "text"])
                    refs, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(texts, pa.string())], ["ref", "text"])

    return docs.select("norm_id", "text").mapInArrow(run, "ref string, text string")


def latest_chunks(chunks: DataFrame, order: str, dimensions: int | None = None) -> DataFrame:
    """One row a chunk_id, the last loaded: structural references can collide. With `dimensions` a vector of another length is an error."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    if dimensions is not None:
        chunks = chunks.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding has not {dimensions} dimensions"))))
    return chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("chunk_id", *(F.col(f"r.{c}") for c in rest))


def same_ids(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold exactly the same chunk ids."""
    a, b = left.select("chunk_id"), right.select("chunk_id")
    return a.join(b, "chunk_id", "left_anti").isEmpty() and b.join(a, "chunk_id", "left_anti").isEmpty()


# ---------------------------------------------------------------- enriched text


def salient(text):
    """The stand-in for summaries: of all sentences (also cut at line ends) the one with most distinct words, the first of several."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    best = F.array_max(F.transform(sentences, lambda s, i: F.struct(F.size(F.array_distinct(tokens(s))).alias("words"), (-i).alias("at"))))
    return F.get(sentences, -best["at"])


def contextual(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks(chunk_id, doc_id, text), docs(doc_id, context): context, a blank line, the chunk. What comes out can go in
    again: a summary goes before what the chunk has already."""
    return chunks.join(docs.select("doc_id", "context"), "doc_id").select("chunk_id", "doc_id", F.concat_ws("\n\n", "context", "text").alias("text"))


def raptor(leaves: DataFrame, group: int = 5, levels: int = 5) -> DataFrame:
    """leaves(doc_id, ord, node_id, text, ids): summaries of `group` neighbours, level by level, until one node is left
    or `levels` are made; all levels together. Positions follow from `ord`, so a level is one grouping without a sort. Each level
    is stored, as what follows reads it three times."""
    out = leaves.select("doc_id", F.lit(0).alias("level"), F.col("ord").cast("long").alias("ord"), "node_id", "text", "ids")
    out = level = stored(out, "level-0")
    for k in range(1, levels + 1):
        sizes = level.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        # a node's sentence is chosen where the node lies: only that is shuffled
        up = level.join(sizes, "doc_id").select("doc_id", "ord", salient(F.col("text")).alias("lead"), "ids")
        up = up.groupBy("doc_id", F.floor(F.col("ord") / group).alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "lead", "ids"))).alias("parts"))
        level = up.select(
            "doc_id", F.lit(k).alias("level"), "ord", F.concat_ws("::", F.lit("summary"), F.col("doc_id").cast("string"), F.lit(str(k)), F.col("ord").cast("string")).alias("node_id"),
            F.array_join(F.transform("parts", lambda p: p["lead"]), "\n").alias("text"), F.array_distinct(F.flatten(F.transform("parts", lambda p: p["ids"]))).alias("ids"),
        )
        level = stored(level, f"level-{k}")
        out = out.unionByName(level)
    return out
