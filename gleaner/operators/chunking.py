"""Chunking: fixed windows, headings and code, as functions on one text and as Arrow batches.

Every strategy looks back from a window's end or keeps running state, which as a Catalyst
expression means interpreted lambdas that copy the text many times over (measured: some
twenty times slower than one pass over Arrow batches), so all run there. No shuffle.

Sizes are given in tokens and one token counts as four units: code points for fixed windows,
UTF-8 bytes for the other two. All positions are half-open and lines count from 0.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.paths import CODE_LANGUAGES
from gleaner.runtime import spread

UNITS = 4
#: Index values of one document that are ordered in one task.
SPAN = 8192
CHUNK = "chunk_index int, start_byte long, end_byte long, start_line int, end_line int, depth short, symbol_type string, symbol_name string, content string"


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens of four units."""

    target: int = 512
    maximum: int = 1024
    overlap: int = 64

    def __post_init__(self) -> None:
        if self.target < 1 or self.maximum < 1 or self.overlap < 0:
            raise ValueError("target and maximum must be positive and overlap not negative")


# ---------------------------------------------------------------- fixed windows


_STOP = re.compile(r"[.!?](?=\s)")


def break_point(text: str, start: int, end: int) -> int:
    """Where a window of code points that would end at ``end`` should end instead.

    Looked for backwards from a tenth of the window after ``end`` to a fifth before it: the
    position after a blank line, else after a line feed, else after a sentence mark that white
    space follows; else ``end`` itself. The end of the text stays.
    """
    if end >= len(text):
        return len(text)
    lo, hi = end - (end - start) // 5, min(end + (end - start) // 10, len(text))
    for mark, until in (("\n\n", hi + 1), ("\n", hi)):
        at = text.rfind(mark, lo, until)
        if at >= 0:
            return at + len(mark)
    stops = [m.end() for m in _STOP.finditer(text[lo : hi + 1])]
    return lo + stops[-1] if stops else end


def fixed_spans(text: str, config: ChunkConfig, gapless: bool = False) -> list[tuple[int, int]]:
    """Spans of windows in code points; an empty text has none.

    Windows start at multiples of ``target - overlap`` whatever the break point of the one
    before (or, ``gapless``, no later than where that ends), and the first that reaches the
    end of the text is the last.
    """
    width, step = UNITS * config.target, max(1, UNITS * (config.target - config.overlap))
    out, start = [], 0
    while start < len(text):
        end = break_point(text, start, min(start + width, len(text)))
        out.append((start, end))
        if end >= len(text):
            break
        start = max(start + 1, min(start + step, end)) if gapless else start + step
    return out


def fixed_windows(text: str, config: ChunkConfig | None = None, gapless: bool = False) -> list[dict]:
    """Fixed windows with their byte and line ranges; positions are counted on from window to window."""
    rows, at, byte, line = [], 0, 0, 0
    ascii_only = text.isascii()
    for s, e in fixed_spans(text, config or ChunkConfig(), gapless):
        byte += s - at if ascii_only else len(text[at:s].encode("utf-8", "surrogatepass"))
        line += text.count("\n", at, s)
        at, content = s, text[s:e]
        rows.append(_row(content, byte, byte + (len(content) if ascii_only else _utf8(content)), line, line + content.count("\n")))
    return rows


def _row(content: str, start: int, end: int, line: int | None, line_end: int | None, kind: str | None = None, name: str | None = None) -> dict:
    return dict(start_byte=start, end_byte=end, start_line=line, end_line=line_end, depth=0, symbol_type=kind, symbol_name=name, content=content)


# ---------------------------------------------------------------- headings


@dataclass
class Section:
    heading: str | None
    level: int
    start: int
    end: int
    body: str

    def rendered(self) -> str:
        body = self.body.strip()
        return body if self.heading is None else f"{'#' * self.level} {self.heading}\n\n{body}"


_ATX = re.compile(r"^\s*(#{1,6})(?!#)\s+(.*)$|^\s*(#{1,6})(?!#)\s$")
_RULE = re.compile(r"^\s*(=+|-+)\s*$")


def _lines(text: str) -> list[tuple[str, int, int]]:
    """``(line without its end, byte start, byte end with the line end)``."""
    out, at = [], 0
    for raw in text.split("\n") if text else []:
        size = len(raw.encode("utf-8", "surrogatepass")) + 1
        out.append((raw.removesuffix("\r"), at, at + size))
        at += size
    if out and text.endswith("\n"):
        out.pop()
    elif out:
        line, s, e = out[-1]
        out[-1] = (line, s, e - 1)
    return out


def heading_of(line: str, before: str | None) -> tuple[int, str, bool] | None:
    """``(level, text, underlined)`` if a line makes a heading, itself or of the line before it."""
    if m := _ATX.match(line):
        return len(m.group(1) or m.group(3)), (m.group(2) or "").strip(), False
    if before and before.strip() and not before.strip().startswith("#") and (m := _RULE.match(line)) and len(m.group(1)) >= 3:
        return (1 if m.group(1)[0] == "=" else 2), before, True
    return None


def sections(text: str) -> list[Section]:
    """The sections that the headings of a text open, with byte spans; what comes before the first has none."""
    lines, marks = _lines(text), []
    for i, (line, start, _) in enumerate(lines):
        if found := heading_of(line, lines[i - 1][0] if i else None):
            level, title, under = found
            first = i - 1 if under else i
            marks.append((first, i + 1, level, title.strip() if not under else title, lines[first][1] if under else start))
    size = len(text.encode("utf-8", "surrogatepass"))
    out = []
    opening = [(0, 0, 0, None, 0), *marks]
    for k, (_, after, level, title, start) in enumerate(opening):
        until = opening[k + 1][0] if k + 1 < len(opening) else len(lines)
        end = opening[k + 1][4] if k + 1 < len(opening) else size
        body = "\n".join(x[0] for x in lines[after:until])
        if title is not None or body.strip():
            out.append(Section(title, level, start, end, body))
    return out


def _utf8(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _tail(text: str, size: int) -> str:
    """At most the last ``size`` bytes of a text, from a character's start."""
    return text.encode("utf-8", "surrogatepass")[-size:].decode("utf-8", "ignore") if size else ""


class _Packer:
    """Collects rendered parts into chunks: closed before one would exceed the maximum, and at the target."""

    def __init__(self, config: ChunkConfig):
        self.target, self.maximum = UNITS * config.target, UNITS * config.maximum
        self.rows: list[dict] = []
        self.parts: list[str] = []
        self.size, self.start, self.title = 0, 0, None

    def close(self, nxt: int) -> None:
        if self.parts:
            content = "\n\n".join(self.parts)
            kind = None if self.title is None else "section"
            self.rows.append(_row(content, self.start, self.start + _utf8(content), 0, content.count("\n"), kind, self.title))
        self.parts, self.size, self.title, self.start = [], 0, None, nxt

    def add(self, part: str, start: int, after: int, title: str | None, glue: int) -> None:
        n = _utf8(part)
        if self.parts and self.size + n + glue > self.maximum:
            self.close(start)
        self.size += n + (2 if self.parts else 0)
        self.parts.append(part)
        self.title = title if title is not None else self.title
        if self.size >= self.target:
            self.close(after)


def semantic_chunks(text: str, config: ChunkConfig | None = None) -> list[dict]:
    """Sections packed up to the target size; a section beyond the maximum is cut between paragraphs.

    Byte ranges begin where the first section of a chunk begins and are as long as the chunk's
    re-rendered content; lines are those of the content.
    """
    config = config or ChunkConfig()
    pack = _Packer(config)
    for s in sections(text):
        part = s.rendered()
        if _utf8(part) <= pack.maximum:
            pack.add(part, s.start, s.end, s.heading, 0)
            continue
        pack.close(s.end)
        at, held = s.start, ""
        for p in filter(None, (p.strip() for p in part.split("\n\n"))):
            if held and _utf8(held) + _utf8(p) > pack.target:
                pack.rows.append(_row(held, at, at + _utf8(held), 0, held.count("\n"), None, s.heading))
                keep = _tail(held, UNITS * config.overlap)
                at += _utf8(held) - _utf8(keep)
                held = f"{keep}\n\n{p}"
            else:
                held = f"{held}\n\n{p}" if held else p
        if held:
            pack.rows.append(_row(held, at, at + _utf8(held), 0, held.count("\n"), None, s.heading))
    pack.close(0)
    return pack.rows


def render_element(e: dict) -> str:
    """An extracted element (heading, paragraph, code, list, table) as Markdown."""
    kind = e["kind"]
    if kind == "heading":
        return f"{'#' * int(e['level'])} {e['text']}"
    if kind == "code":
        return f"```{e.get('language') or ''}\n{e['text']}\n```"
    if kind == "list":
        return "\n".join(f"{i}. {x}" if e.get("ordered") else f"- {x}" for i, x in enumerate(e["items"], 1))
    if kind == "table":
        bar = lambda cells: f"| {' | '.join(cells)} |\n"
        return bar(e["headers"]) + bar(["---"] * len(e["headers"])) + "".join(bar(r) for r in e["rows"])
    return e["text"]


def element_chunks(elements: list[dict], config: ChunkConfig | None = None) -> list[dict]:
    """Elements rendered to Markdown and packed; an element beyond the maximum stays whole."""
    pack = _Packer(config or ChunkConfig())
    for e in elements:
        part, at = render_element(e), int(e.get("byte_offset") or 0)
        pack.add(part, at, at + _utf8(part), e["text"].strip() if e["kind"] == "heading" else None, 2)
    pack.close(0)
    return pack.rows


# ---------------------------------------------------------------- code

_NAME = r"(?P<name>[^\s(<{:]+)"
_CLASSY = r"{0}\b\s*(?:<[^>]*>)?\s*(?P<name>[^\s{{(<:]*)"
#: Per language: what a stripped line must look like to open a symbol, tried in order.
SYMBOLS: dict[str, list[tuple[str, re.Pattern]]] = {
    "rust": [
        ("function", re.compile(rf"(?:pub(?:\((?:crate|super)\))? )?(?:async )?fn {_NAME}")),
        ("impl", re.compile(r"impl(?:<[^>]*>)?\s+(?P<name>[^\s{(<:]+)")),
        ("struct", re.compile(rf"(?:pub(?:\(crate\))? )?struct {_NAME}")),
        ("enum", re.compile(rf"(?:pub(?:\(crate\))? )?enum {_NAME}")),
        ("module", re.compile(r"(?:pub )?mod (?P<name>[^\s({<:;]+)")),
    ],
    "python": [("function", re.compile(rf"(?:async )?def {_NAME}")), ("class", re.compile(rf"class {_NAME}"))],
    "javascript": [
        ("function", re.compile(rf"(?:export )?(?:async )?function {_NAME}")),
        ("function", re.compile(r"(?:export )?const (?P<name>\S+?)(?::.*?)? = (?:async )?\(")),
        ("class", re.compile(rf"(?:export (?:default )?)?class {_NAME}")),
        ("struct", re.compile(rf"(?:export )?(?:interface|type) {_NAME}")),
    ],
    "go": [
        ("method", re.compile(r"func \([^)]*\) (?P<name>[^\s(]+)")),
        ("function", re.compile(r"func (?P<name>[^\s([]+)")),
        ("struct", re.compile(r"type (?P<name>\S+) .*?(?:struct|interface)")),
    ],
    "java": [
        ("class", re.compile(r"(?:.* )?class (?P<name>[^\s{(<:]+)")),
        ("struct", re.compile(r"(?:.* )?interface (?P<name>[^\s{(<:]+)")),
        ("enum", re.compile(r"(?:.* )?enum (?P<name>[^\s{(<:]+)")),
        ("method", re.compile(r".*\b(?:public|private|protected) [^(]*?(?P<name>[^\s(]+)\s*\(")),
    ],
    "c": [
        ("class", re.compile(r"(?:.* )?class (?P<name>[^\s{(<:]+)")),
        ("struct", re.compile(r"(?:.* )?struct (?P<name>[^\s{(<:]+)")),
        ("enum", re.compile(r"(?:.* )?enum (?P<name>[^\s{(<:]+)")),
        # fixed values: the control words that open no function
        ("function", re.compile(r"[^(]*?(?<![\w*&])[*&]*(?!(?i:if|while|for|switch|return|sizeof|typeof)\s*\()(?P<name>\w+)\s*\(")),
    ],
}
SYMBOLS["typescript"] = SYMBOLS["javascript"]
SYMBOLS["cpp"] = SYMBOLS["c"]
_ANY = ("rust", "python", "javascript", "go", "java", "c")


def code_boundary(line: str, language: str | None) -> tuple[str, str | None] | None:
    """``(kind, name)`` if a line opens a function, method, class, struct, enum, impl or module.

    Blank lines and comment lines open nothing; an unknown language tries all in turn.
    """
    t = line.strip()
    if not t or t.startswith(("//", "#")):
        return None
    for lang in [language] if language in SYMBOLS else _ANY:
        for kind, pattern in SYMBOLS[lang]:
            if m := pattern.match(t):
                return kind, m.group("name") or None
    return None


def _span(lines: list[tuple[str, int, int]], a: int, b: int, size: int) -> tuple[int, int]:
    return (lines[a][1] if a < len(lines) else size), (lines[b - 1][2] if b > a else lines[a][1])


def _by_lines(lines: list[tuple[str, int, int]], base: int, config: ChunkConfig, step_back: Callable[[int, int], int], kind: str | None, name: str | None, stop_at_end: bool) -> list[dict]:
    out, start, target = [], 0, UNITS * config.target
    while start < len(lines):
        size, end = 0, start
        while end < len(lines) and size < target:
            size += lines[end][2] - lines[end][1]
            end += 1
        content = "\n".join(x[0] for x in lines[start:end])
        out.append(_row(content, lines[start][1], lines[end - 1][2], base + start, base + end, kind, name))
        if end >= len(lines) and stop_at_end:
            break
        start = max(start + 1, step_back(start, end) if size else end)
    return out


def code_chunks(text: str, language: str | None = None, config: ChunkConfig | None = None, keep_preamble: bool = False, stop_at_end: bool = True) -> list[dict]:
    """One chunk from each symbol's line to the next; symbols beyond the maximum are cut between lines.

    What comes before the first symbol is left out unless ``keep_preamble``. Without symbols
    the text is cut by lines. Byte and line ranges are those of the text.
    """
    config = config or ChunkConfig()
    lines = _lines(text)
    if not lines:
        return []
    marks = [(i, *b) for i, x in enumerate(lines) if (b := code_boundary(x[0], language))]
    if not marks:
        back = UNITS * config.overlap // 80
        return _by_lines(lines, 0, config, lambda s, e: e - back, None, None, stop_at_end)
    if keep_preamble and marks[0][0] > 0:
        marks.insert(0, (0, None, None))
    out = []
    step = max(1, UNITS * (config.target - config.overlap))
    for k, (at, kind, name) in enumerate(marks):
        until = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        part = lines[at:until]
        content = "\n".join(x[0] for x in part)
        if _utf8(content) > UNITS * config.maximum:

            def advance(s: int, e: int, part: list = part) -> int:
                mean = max(1, (part[e - 1][2] - part[s][1]) // (e - s))
                return min(e, s + max(1, step // mean))

            out += _by_lines(part, at, config, advance, kind, name, True)
        else:
            out.append(_row(content, part[0][1], part[-1][2], at, until, kind, name))
    return out


# ---------------------------------------------------------------- routing


def chunk_text(text: str | None, content_type: str, config: ChunkConfig | None = None) -> list[dict]:
    """Chunks of one text by its content type: code by symbols, text and Markdown by headings."""
    if not text:
        return []
    if content_type.startswith("code:"):
        tag = content_type[5:].lower()
        return code_chunks(text, CODE_LANGUAGES.get(tag, tag), config)
    return semantic_chunks(text, config)


def chunk_documents(
    df: DataFrame, text_col: str = "text", type_col: str = "content_type", config: ChunkConfig | None = None, strategy: str = "auto", gapless: bool = False, elements_col: str | None = None
) -> DataFrame:
    """The columns of ``df`` without the text, and one row per chunk.

    ``strategy``: ``auto`` sends ``code:*`` to symbols, ``text`` and ``markdown`` to headings and
    the rest to fixed windows; ``fixed``, ``semantic`` and ``code`` send everything one way.
    ``elements_col`` names extracted elements, which are packed instead of the text where headings
    would decide, if there are any. Null and empty texts give no chunk; a null type counts as text.
    """
    if strategy not in ("auto", "fixed", "semantic", "code"):
        raise ValueError(f"unknown strategy {strategy}")
    config = config or ChunkConfig()
    fresh = {c.split()[0] for c in CHUNK.split(", ")}
    keep = [c for c in df.columns if c not in fresh and c not in (text_col, elements_col)]
    kind = F.coalesce(F.col(type_col), F.lit("text")) if type_col in df.columns else F.lit("text")
    given = F.lit(None).cast("string") if elements_col is None else F.to_json(elements_col)
    rows = spread(df.select(*keep, kind.alias("_kind"), F.col(text_col).alias("_t"), given.alias("_e")).where(F.col("_t") != ""))

    def one(text: str, tag: str, given: str | None) -> list[dict]:
        elements = json.loads(given) if given and (strategy == "semantic" or (strategy == "auto" and tag in ("text", "markdown"))) else []
        if elements:
            return element_chunks(elements, config)
        if strategy == "fixed":
            return fixed_windows(text, config, gapless)
        if strategy == "semantic":
            return semantic_chunks(text, config)
        if strategy == "code" or tag.startswith("code:"):
            name = tag[5:].lower() if tag.startswith("code:") else None
            return code_chunks(text, CODE_LANGUAGES.get(name, name), config)
        if tag in ("text", "markdown"):
            return semantic_chunks(text, config)
        return fixed_windows(text, config, gapless)

    names = [c.split()[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [one(t, k, e) for t, k, e in zip(pdf["_t"], pdf["_kind"], pdf["_e"], strict=True)]
            at = [i for i, rows in enumerate(lists) for _ in rows]
            flat = [r | {"chunk_index": k} for rows in lists for k, r in enumerate(rows)]
            if flat:
                chunks = pd.DataFrame(flat, columns=names)
                yield pd.concat([pdf[keep].iloc[at].reset_index(drop=True), chunks], axis=1)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    schema = f"{head}, {CHUNK}" if head else CHUNK
    return rows.mapInPandas(run, schema)


def fixed_chunks(df: DataFrame, text_col: str = "text", config: ChunkConfig | None = None, gapless: bool = False) -> DataFrame:
    """The columns of ``df`` without the text, and one row per window; see :func:`chunk_documents`."""
    return chunk_documents(df, text_col, config=config, strategy="fixed", gapless=gapless)


def split_documents(df: DataFrame, text_col: str = "page_content", metadata_col: str = "metadata", config: ChunkConfig | None = None, strategy: str = "auto") -> DataFrame:
    """Documents ``(page_content, metadata map)`` as one document per chunk.

    The metadata gain chunk_index, start_byte, end_byte, start_line and end_line as strings.
    The content type is taken from the metadata's ``content_type``; a null map counts as empty.
    """
    docs = df.select(F.col(text_col).alias("_p"), F.coalesce(F.col(metadata_col), F.create_map().cast("map<string,string>")).alias("_m"))
    docs = docs.withColumn("content_type", F.coalesce(F.try_element_at("_m", F.lit("content_type")), F.lit("text")))
    out = chunk_documents(docs, "_p", "content_type", config, strategy)
    spans = [x for c in ("chunk_index", "start_byte", "end_byte", "start_line", "end_line") for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    fresh = F.create_map(*spans)
    old = F.map_filter("_m", lambda k, _: ~k.isin("chunk_index", "start_byte", "end_byte", "start_line", "end_line"))
    return out.select(F.col("content").alias("page_content"), F.map_concat(old, fresh).alias("metadata"))


def linked(chunks: DataFrame, key: str = "file_path", order: str = "chunk_index", id_col: str = "chunk_id") -> DataFrame:
    """Chunks with the ids of the one before and after in their document.

    Documents are cut into spans of ``SPAN`` index values that are ordered on their own, and
    the ends of neighbouring spans are joined on, so a document of any length takes many tasks.
    A null index comes first.
    """
    rows = chunks.withColumn("_span", F.coalesce(F.floor(F.col(order) / SPAN), F.lit(-(1 << 62))))
    within = Window.partitionBy(key, "_span").orderBy(order, id_col)
    rows = rows.withColumn("_b", F.lag(id_col).over(within)).withColumn("_a", F.lead(id_col).over(within))
    here = F.struct(order, id_col)
    spans = rows.groupBy(key, "_span").agg(F.min(here).alias("lo"), F.max(here).alias("hi"))
    across = Window.partitionBy(key).orderBy("_span")
    spans = spans.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), F.lag(f"hi.{id_col}").over(across).alias("_p"), F.lead(f"lo.{id_col}").over(across).alias("_n"))
    out = rows.join(spans, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_span") == F.col("_s")))
    return out.withColumn("previous_id", F.coalesce("_b", "_p")).withColumn("next_id", F.coalesce("_a", "_n")).drop("_span", "_b", "_a", "_k", "_s", "_p", "_n")


def assemble(chunks: DataFrame, path: str, file_id: str, content_hash: str, content_type: str, model: str | None = None) -> DataFrame:
    """Chunk rows with deterministic ids, the layout's constants and a slot for the vector."""
    ident = F.sha2(F.concat_ws("\x1f", F.col(path), F.col("chunk_index").cast("string"), F.col(content_hash)), 256)
    language = F.when(F.col(content_type).startswith("code:"), F.substring(F.col(content_type), 6, 64))
    return chunks.withColumns(
        {
            "chunk_id": ident, "file_id": F.col(file_id), "file_path": F.col(path), "content_type": F.col(content_type), "parent_chunk_id": F.lit(None).cast("string"),
            "embedding_model": F.lit(model).cast("string"), "language": language, "indexed_at": F.current_timestamp(),
        }
    )
