"""Documents as sections, and sinks: markdown, plain text, conversations, source code, paged text, directories, exports.

A section row is (doc, idx, heading, depth, text). Files come through Spark's readers, so any store will do.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import running_sum, with_previous

SECTIONS = "doc string, idx int, heading string, depth int, text string"
CODE = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "rb": "ruby", "cs": "csharp"}
KINDS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf", "json": "conversation", "jsonl": "conversation"} | {e: "code" for e in CODE}


def source_kind(path):
    """The kind of a source by the extension of its path; text where it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("text"))


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content, kind) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content", source_kind(F.col("path")).alias("kind"))


def _sections(docs: DataFrame, parse) -> DataFrame:
    def run(batches):
        for t in batches:
            rows = [(d, i, h, n, s) for d, x in zip(t["doc"], t["text"]) for i, (h, n, s) in enumerate(parse(x or ""))]
            yield pd.DataFrame(rows, columns=["doc", "idx", "heading", "depth", "text"])

    return docs.select(F.col("doc").cast("string").alias("doc"), "text").mapInPandas(run, SECTIONS)


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def markdown_sections(text: str) -> list[tuple[str | None, int, str]]:
    """(heading, depth, text): what stands under each heading; fenced code is text, also if it looks like a heading."""
    out: list[list] = [[None, 0, []]]
    fence = None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if m and (fence is None or (m[1][0] == fence[0] and len(m[1]) >= len(fence))):
            fence = m[1] if fence is None else None
        h = _HEADING.match(line) if fence is None and not m else None
        if h:
            out.append([(h[2] or "").strip(), len(h[1]), []])
        else:
            out[-1][2].append(line)
    parts = [(h, d, "\n".join(t).strip("\n").rstrip()) for h, d, t in out]
    return [p for p in parts if p[0] is not None or p[2].strip()]


def markdown(docs: DataFrame) -> DataFrame:
    return _sections(docs, markdown_sections)


#: What a heading line in plain text begins with, the letters and lengths of its numerals, and what may stand between capitals.
NUMBERED = ("ARTICLE", "CHAPTER", "PART")
SECTIONED = ("SECTION", "Section")
NUMERAL_LETTERS = "IVXLCDM"
NUMERAL_LENGTH, OUTLINE_LENGTH, CAPITALS_LENGTH = 8, 5, 4
BETWEEN_CAPITALS = " &/-"


def is_capital(c: str) -> bool:
    return c.isascii() and c.isupper()


def is_numeral(word: str, most: int) -> bool:
    return 0 < len(word) <= most and all(c in NUMERAL_LETTERS for c in word)


def _names_a_part(words: list[str]) -> bool:
    """CHAPTER IV, ARTICLE 7, Section 2.1, or an outline's numeral and letter, such as II. A."""
    if len(words) != 2:
        return False
    first, second = words
    if first in NUMBERED:
        return second.isdecimal() or is_numeral(second, NUMERAL_LENGTH)
    if first in SECTIONED:
        return all(n.isdecimal() for n in second.split("."))
    return first.endswith(".") and is_numeral(first[:-1], OUTLINE_LENGTH) and len(second) == 1 and is_capital(second)


def _is_of_capitals(line: str) -> bool:
    """A title in capitals, from the first character to the last."""
    return len(line) >= CAPITALS_LENGTH and is_capital(line[0]) and is_capital(line[-1]) and all(is_capital(c) or c in BETWEEN_CAPITALS for c in line)


def is_heading(line: str) -> bool:
    """Whether a line is nothing but a heading, closed perhaps by a colon or a full stop."""
    line = line.strip(" \t")
    closed = line[:-1].rstrip(" \t") if line.endswith((":", ".")) else line
    return any(x == x.strip() and (_names_a_part(x.split()) or _is_of_capitals(x)) for x in (line, closed))


def text_sections(text: str) -> list[tuple[str | None, int, str]]:
    """Sections under lines such as CHAPTER 4, Section 2.1 or METHODS; with fewer than two of them, the whole text is one."""
    if not text:
        return []
    lines = text.split("\n")
    heads = [i for i, line in enumerate(lines) if is_heading(line)]
    if len(heads) < 2:
        return [(None, 0, text)]
    lead = "\n".join(lines[: heads[0]]).strip()
    out: list[tuple[str | None, int, str]] = [(None, 0, lead)] if lead else []
    for a, b in zip(heads, [*heads[1:], len(lines)]):
        out.append((lines[a].strip(), 1, "\n".join(lines[a + 1 : b]).strip()))
    return out


def plain_text(docs: DataFrame) -> DataFrame:
    return _sections(docs, text_sections)


def paged_text(docs: DataFrame) -> DataFrame:
    """Extracted text with form feeds: a section for each page that isn't blank, numbered by its page."""
    t = docs.select(F.col("doc").cast("string").alias("doc"), F.posexplode(F.split("text", "\f")).alias("idx", "page"))
    return t.where(F.trim("page") != "").select("doc", "idx", F.concat(F.lit("Page "), (F.col("idx") + 1).cast("string")).alias("heading"), F.lit(1).alias("depth"), F.trim("page").alias("text"))


_ITEMS = {
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|impl|mod)\s+([A-Za-z_]\w*)", "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "javascript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+([A-Za-z_$]\w*)", "typescript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+)?(function|class|interface|enum)\s+([A-Za-z_$]\w*)",
    "java": r"^[ \t]*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)", "csharp": r"^[ \t]*(?:public\s+|private\s+|internal\s+|static\s+|sealed\s+)*(class|interface|enum|struct)\s+([A-Za-z_]\w*)",
    "ruby": r"^[ \t]*(class|module|def)\s+([A-Za-z_]\w*[?!]?)", "c": r"^(struct|enum|union)\s+([A-Za-z_]\w*)", "cpp": r"^(class|struct|enum|namespace)\s+([A-Za-z_]\w*)",
}


def code_sections(text: str, language: str) -> list[tuple[str | None, int, str]]:
    """A section for each item, headed kind:name; the whole file where nothing is found or it can't be parsed."""
    out: list[tuple[str | None, int, str]] = []
    if language == "python":
        try:
            for node in ast.parse(text).body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    out.append((f"{'class' if isinstance(node, ast.ClassDef) else 'function'}:{node.name}", 1, ast.get_source_segment(text, node) or ""))
        except (SyntaxError, ValueError):
            out = []
    elif language in _ITEMS:
        heads = list(re.finditer(_ITEMS[language], text, re.M))
        out = [(f"{a[1]}:{a[2]}", 1, text[a.start() : b.start() if b else len(text)].rstrip()) for a, b in zip(heads, [*heads[1:], None])]
    return out or ([(None, 0, text)] if text.strip() else [])


def code(docs: DataFrame, language: str) -> DataFrame:
    return _sections(docs, lambda x: code_sections(x, language))


# --- conversations --------------------------------------------------------------------------------------------


def conversation_format(raw):
    """claude: an object with `conversation`; chatgpt: an array whose first element has `mapping`; else generic."""
    v = F.try_parse_json(raw)
    return F.when(F.try_variant_get(v, "$.conversation", "string").isNotNull(), "claude").when(F.try_variant_get(v, "$[0].mapping", "string").isNotNull(), "chatgpt").otherwise("generic")


_MESSAGE = "array<struct<role:string,sender:string,content:string,text:string>>"
_CHATGPT = "array<struct<mapping:map<string,struct<message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>>>>"


def conversations(docs: DataFrame) -> DataFrame:
    """Sections of chat exports (doc, text), one for each message: heading [role], depth 2. Blank messages are left out.

    Exports that hold a map of messages are ordered by time, then by key, times that are missing last."""
    t = docs.select(F.col("doc").cast("string").alias("doc"), "text", conversation_format(F.col("text")).alias("format"))
    listed = t.where("format <> 'chatgpt'")
    messages = F.when(F.col("format") == "claude", F.from_json("text", f"struct<conversation:{_MESSAGE}>")["conversation"]).otherwise(F.coalesce(F.from_json("text", _MESSAGE), F.from_json("text", f"struct<messages:{_MESSAGE}>")["messages"]))
    flat = listed.select("doc", F.posexplode(messages).alias("pos", "m")).select("doc", F.lit(0.0).alias("time"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("key"), F.coalesce("m.role", "m.sender").alias("role"), F.coalesce("m.content", "m.text").alias("body"))
    mapped = t.where("format = 'chatgpt'").select("doc", F.posexplode(F.from_json("text", _CHATGPT)).alias("c", "conv")).select("doc", "c", F.explode("conv.mapping").alias("key", "node"))
    mapped = mapped.where("node.message is not null").select("doc", F.coalesce("node.message.create_time", F.lit(float("inf"))).alias("time"), "key", F.col("node.message.author.role").alias("role"), F.array_join("node.message.content.parts", "\n\n").alias("body"))
    every = flat.unionByName(mapped).where(F.trim("body") != "")
    # messages of one document, in order
    lists = every.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("time", "key", "role", "body"))).alias("all"))
    return lists.select("doc", F.posexplode("all").alias("idx", "m")).select("doc", "idx", F.concat(F.lit("["), F.coalesce("m.role", F.lit("unknown")), F.lit("]")).alias("heading"), F.lit(2).alias("depth"), F.col("m.body").alias("text"))


def message_table(messages: DataFrame, doc: str, order: str, role: str, text: str) -> DataFrame:
    """Sections of messages that are rows already."""
    return messages.where(F.trim(text) != "").select(F.col(doc).cast("string").alias("doc"), F.col(order).cast("int").alias("idx"), F.concat(F.lit("["), F.col(role), F.lit("]")).alias("heading"), F.lit(2).alias("depth"), F.col(text).alias("text"))


# --- sinks ----------------------------------------------------------------------------------------------------


def write_snapshot(df: DataFrame, path: str, by: str | None = None) -> None:
    """A snapshot as parquet, split by label or commit where that is what queries ask for."""
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def export_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks (cid, content) as lines of {"cid", "hex"}, each once."""
    blocks.dropDuplicates(["cid"]).select("cid", F.lower(F.hex("content")).alias("hex")).write.mode("overwrite").json(path)


def import_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(cid, content) of an export; a block whose content has another hash ends the import with an error."""
    t = spark.read.schema("cid string, hex string").json(path).select("cid", F.unhex("hex").alias("content"))
    wrong = F.raise_error(F.concat(F.lit("block "), "cid", F.lit(" has other content"))).cast("binary")
    return t.select("cid", F.when(F.sha2("content", 256).eqNullSafe(F.col("cid")), F.col("content")).otherwise(wrong).alias("content"))


def author_runs(rows: DataFrame, order: str, author: str) -> DataFrame:
    """rows with `run`: the commit that a bulk insert makes of them, one for each run of equal authors that follow one another.

    An author that comes again later is another run. Rows are dealt to ranges of their order, so no task holds them all."""
    t = with_previous(rows.withColumn("_author", F.struct(F.col(author))), order, of=F.col("_author"), name="_previous")
    new = ~F.col("_previous").eqNullSafe(F.col("_author"))  # nothing stands before the first row
    return running_sum(t, order, of=new.cast("int"), name="run").drop("_author", "_previous")


def ingest(docs: DataFrame, kind: str = "markdown", chunker: str = "auto", language: str = "python") -> dict[str, DataFrame]:
    """documents, chunks, entities and edges of (doc, text): chunk_of, chunk_mentions, and a relation between each two entities
    of a chunk that stand near each other. Ids come from the content, so a second ingest adds nothing. language: of code."""
    from ..functions import content_hash, short_summary
    from ..operators.chunk import chunk
    from ..operators.extract import canonical_entities, entities, relations

    own = docs.select(F.col("doc").cast("string").alias("doc"), "text")
    sections = {"markdown": markdown, "text": plain_text, "pdf": paged_text, "conversation": conversations, "code": lambda d: code(d, language)}[kind](own)
    ident = lambda *parts: F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)
    chunks = chunk(sections, kind, chunker).withColumn("id", ident(F.lit("Chunk"), "doc", F.col("idx").cast("string"), "text"))
    found = entities(chunks.select(F.col("id").alias("doc"), "text"))
    of = chunks.select(F.col("id").alias("chunk"), F.col("doc").alias("of"))
    mentions = found.join(of, found["doc"] == of["chunk"]).select(F.col("of").alias("doc"), "chunk", "kind", "text", "ordinal", F.lower(F.trim("text")).alias("name"))
    named = canonical_entities(mentions).withColumn("id", ident(F.lit("Entity"), "doc", "kind", "name"))
    documents = own.select(ident(F.lit("Doc"), "doc", content_hash(F.col("text"))).alias("id"), "doc", short_summary(F.col("text")).alias("summary"))
    belongs = chunks.join(documents.select("doc", F.col("id").alias("dst")), "doc").select(F.lit("chunk_of").alias("etype"), F.col("id").alias("src"), "dst")
    mentioned = mentions.join(named.select("doc", "kind", "name", F.col("id").alias("dst")), ["doc", "kind", "name"]).select(F.lit("chunk_mentions").alias("etype"), F.col("chunk").alias("src"), "dst").distinct()
    related = relations(found, chunks.select(F.col("id").alias("doc"), "text"))
    end = mentions.join(named.select("doc", "kind", "name", F.col("id").alias("entity")), ["doc", "kind", "name"]).select("chunk", "ordinal", "entity")
    ends = [end.select(F.col("chunk").alias("doc"), F.col("ordinal").alias(k), F.col("entity").alias(v)) for k, v in (("subject", "src"), ("object", "dst"))]
    linked = related.join(ends[0], ["doc", "subject"]).join(ends[1], ["doc", "object"]).where("src <> dst").select(F.col("kind").alias("etype"), "src", "dst").distinct()
    return {"documents": documents, "chunks": chunks, "entities": named, "edges": belongs.unionByName(mentioned).unionByName(linked)}
