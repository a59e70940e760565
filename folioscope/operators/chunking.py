"""Chunks: children and parents of blocks, forced splits, fixed windows, recursive and semantic splits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.arrow import arrow_schema, batch_of
from folioscope.operators import seams
from folioscope.operators.normalize import SPECIAL
from folioscope.operators.seams import CodePoints
from folioscope.sources.work import kept

BETWEEN = "\n\n"
_TEXTS = 64  # texts whose pieces a task holds at once
CHUNKS = (
    "version_id string, level string, seq int, chunk_id string, parent_chunk_id string, previous_id string, next_id string, text string, token_count int, "
    "page_start int, page_end int, section_path array<string>, content_type string, quality_score double, block_ids array<string>, index_version string"
)


@dataclass(frozen=True)
class ChunkSettings:
    """Limits in tokens. The least sizes are recorded only; the most bind."""

    child_min: int = 300
    child_max: int = 600
    parent_min: int = 1200
    parent_max: int = 1800
    overlap_ratio: float = 0.1
    version: str = "parent-child-v1"

    def parameters(self) -> dict:
        return asdict(self)


def forced_split(rows: DataFrame, limit: int, ratio: float) -> DataFrame:
    """Rows (id, text) in windows of ``limit`` characters; a tail no longer than the overlap isn't started."""
    overlap = round(limit * ratio)
    step = max(limit - overlap, 1)
    pieces = F.filter(tx.windows(F.col("text"), limit, limit - step), lambda x, i: (i == 0) | (F.length(x) > overlap))
    return rows.select("id", F.posexplode(pieces).alias("part", "piece"))


def fixed_windows(rows: DataFrame, width: int = 400, overlap: int = 80) -> DataFrame:
    return rows.select("id", F.posexplode(tx.windows(F.col("text"), width, overlap)).alias("part", "piece"))


def token_windows(rows: DataFrame, tokenizer: seams.Tokenizer, width: int = 500, overlap: int = 80) -> DataFrame:
    """Rows (id, text) as (id, part, piece): fixed windows of a tokenizer's tokens; those of characters are cut in the JVM."""
    if isinstance(tokenizer, CodePoints):
        windows = F.filter(tx.windows(F.col("text"), width, overlap), lambda x, i: (i == 0) | (F.length(x) > overlap))
        return rows.select("id", F.posexplode(windows).alias("part", "piece"))

    @F.pandas_udf("array<string>")
    def pieces(texts):
        return texts.map(lambda t: [] if t is None else _pieces(tokenizer, tokenizer.encode(t), width, overlap))

    return rows.select("id", F.posexplode(pieces("text")).alias("part", "piece"))


def _pieces(tokenizer: seams.Tokenizer, tokens: list, limit: int, overlap: int) -> list[str]:
    step = max(limit - overlap, 1)
    starts = [i for i in range(0, len(tokens), step) if i == 0 or len(tokens) - i > overlap]
    return [tokenizer.decode(tokens[i : i + limit]) for i in starts]


@dataclass
class _Piece:
    text: str
    size: int
    first_page: int | None
    last_page: int | None
    section: list[str]
    kind: str
    quality: float | None
    blocks: list[str]


class _Packer:
    """One document's blocks, in order, to its chunks, in one pass."""

    def __init__(self, version: str | None, settings: ChunkSettings, tokenizer: seams.Tokenizer) -> None:
        self.version, self.limits, self.tokenizer = version, settings, tokenizer
        self.open: list[tuple[_Piece, list]] = []
        self.children: list[_Piece] = []
        # sizes add up when tokens are characters; other tokenizers look at the joined text
        self.additive = isinstance(tokenizer, CodePoints)

    def size(self, texts: list[str], known: int) -> int:
        if self.additive:
            return known
        return len(self.tokenizer.encode(BETWEEN.join(texts)))

    def add(self, block: _Piece) -> None:
        tokens = self.tokenizer.encode(block.text)
        block.size = len(tokens)
        if block.kind in SPECIAL:
            self.close()
            self.split(block, tokens)
            return
        block.kind = "text"
        if self.open:
            held = [b for b, _ in self.open]
            joined = self.size([b.text for b in held] + [block.text], sum(b.size for b in held) + block.size + len(BETWEEN) * len(held))
            if held[-1].section != block.section or joined > self.limits.child_max:
                self.close()
        self.open.append((block, tokens))

    def close(self) -> None:
        if len(self.open) == 1:
            self.split(*self.open[0])
        elif self.open:
            self.children.append(_merged([b for b, _ in self.open], self))
        self.open = []

    def split(self, block: _Piece, tokens: list) -> None:
        limit = self.limits.child_max
        if len(tokens) <= limit:
            self.children.append(block)
            return
        for text in _pieces(self.tokenizer, tokens, limit, round(limit * self.limits.overlap_ratio)):
            size = len(text) if self.additive else len(self.tokenizer.encode(text))
            self.children.append(_Piece(text, size, block.first_page, block.last_page, block.section, block.kind, block.quality, block.blocks))

    def groups(self) -> Iterator[list[int]]:
        held: list[int] = []
        total = 0
        for i, child in enumerate(self.children):
            last = self.children[held[-1]] if held else None
            joined = self.size([self.children[k].text for k in held] + [child.text], total + len(BETWEEN) + child.size) if held else child.size
            if last and (child.section != last.section or child.kind in SPECIAL or last.kind in SPECIAL or joined > self.limits.parent_max):
                yield held
                held, joined = [], child.size
            held.append(i)
            total = joined
        if held:
            yield held

    def rows(self) -> list[tuple]:
        self.close()
        name = lambda level, i, text: _id(level, self.version or "", self.limits.version, str(i), text)
        ids = [name("child", i, c.text) for i, c in enumerate(self.children)]
        out, family = [], {}
        for n, group in enumerate(self.groups()):
            own = [self.children[i] for i in group]
            whole = _merged(own, self) if len(own) > 1 else own[0]
            parent = name("parent", n, whole.text)
            family.update(dict.fromkeys(group, parent))
            out.append(self._row("parent", n, parent, None, None, None, whole))
        for i, child in enumerate(self.children):
            out.append(self._row("child", i, ids[i], family[i], ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None, child))
        return out

    def _row(self, level, seq, own, parent, before, after, c: _Piece) -> tuple:
        return (self.version, level, seq, own, parent, before, after, c.text, c.size, c.first_page, c.last_page, c.section, c.kind, c.quality, c.blocks, self.limits.version)


def _merged(parts: list[_Piece], packer: _Packer) -> _Piece:
    """Several pieces as one: joined text, the span of their pages, one kind or mixed, the mean of known qualities, distinct blocks."""
    texts = [p.text for p in parts]
    known = [p.quality for p in parts if p.quality is not None]
    kinds = {p.kind for p in parts}
    size = packer.size(texts, sum(p.size for p in parts) + len(BETWEEN) * (len(parts) - 1))
    pages = [x for p in parts for x in (p.first_page, p.last_page) if x is not None]
    return _Piece(
        BETWEEN.join(texts), size, min(pages, default=None), max(pages, default=None), parts[0].section, kinds.pop() if len(kinds) == 1 else "mixed",
        sum(known) / len(known) if known else None, list(dict.fromkeys(b for p in parts for b in p.blocks)),
    )


def _id(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]


def build(blocks: DataFrame, settings: ChunkSettings = ChunkSettings(), tokenizer: seams.Tokenizer | None = None, parts: int | None = None) -> DataFrame:
    """Children and their parents (see ``CHUNKS``) of blocks (version_id, position, page_no, section_path, kind, text, block_id, quality).

    Consecutive ordinary blocks of a section join, with an empty line between, while the text stays
    within ``child_max`` tokens. Tables, formulas, captions, pictures and references stand alone; a
    block over the limit is cut into overlapping windows. Children of a section join likewise into
    parents up to ``parent_max``, special ones alone. Children know their parent and neighbours.
    Blocks are sorted by version and position and go through one pass; a document's chunks are held
    until its end. Null texts are empty ones; blocks of a null version are one document. Blocks that
    are by version in ``parts`` partitions already don't move.
    """
    tokenizer = tokenizer or CodePoints()
    names = ["version_id", "position", "page_no", "section_path", "kind", "text", "block_id", "quality"]
    cast = {"version_id": "string", "position": "long", "page_no": "int", "section_path": "array<string>", "kind": "string", "text": "string", "block_id": "string", "quality": "double"}
    held = [F.col(c).cast(cast[c]).alias(c) if c in blocks.columns else F.lit(None).cast(cast[c]).alias(c) for c in names]
    by_version = blocks.repartition(parts, "version_id") if parts else blocks.repartition("version_id")
    dealt = by_version.select(*held).sortWithinPartitions("version_id", "position", "block_id")

    schema = arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made = None, []
        for batch in batches:
            for version, _, page, section, kind, text, block, quality in zip(*(c.to_pylist() for c in batch.columns)):
                if packer is None or version != packer.version:
                    made += packer.rows() if packer else []
                    packer = _Packer(version, settings, tokenizer)
                    if sum(len(r[7]) for r in made) > 1 << 20:
                        yield batch_of(made, schema)
                        made = []
                packer.add(_Piece(text or "", 0, page, page, section or [], kind or "text", quality, [block] if block else []))
        made += packer.rows() if packer else []
        if made:
            yield batch_of(made, schema)

    return dealt.mapInArrow(run, CHUNKS)


def children(chunks: DataFrame) -> DataFrame:
    return chunks.where("level = 'child'")


def parents(chunks: DataFrame) -> DataFrame:
    return chunks.where("level = 'parent'")


def block_links(chunks: DataFrame) -> DataFrame:
    """(chunk_id, position, block_id): the blocks of each chunk, in order."""
    return chunks.select("chunk_id", F.posexplode("block_ids").alias("position", "block_id"))


def source_ids(source, index, piece) -> F.Column:
    """The id of a piece by its source, its number and its content, the same at every run."""
    return F.concat_ws("::", F.coalesce(source, F.lit("")), index, F.substring(F.md5(piece), 1, 12))


def semantic(sentences: DataFrame, percentile: float = 0.92) -> DataFrame:
    """Sentences (doc_id, pos, embedding) to groups, broken where the distance to the next is over the percentile.

    A vector of length zero has no distance to its neighbours, and breaks nothing.
    """
    line = Window.partitionBy("doc_id").orderBy("pos")
    own, before = F.col("embedding"), F.lag("embedding").over(line)
    norm = F.nullif(F.sqrt(tx.dot(own, own)) * F.sqrt(tx.dot(before, before)), F.lit(0.0))
    far = sentences.withColumn("distance", F.round(1 - tx.dot(own, before) / norm, 9))
    cut = far.withColumn("limit", F.percentile("distance", percentile).over(Window.partitionBy("doc_id")))
    starts = F.coalesce((F.col("distance") > F.col("limit")).cast("int"), F.lit(0))
    return cut.withColumn("group", F.sum(starts).over(line.rowsBetween(Window.unboundedPreceding, 0))).select("doc_id", "pos", "group")


#: Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[.?!])\s+"


def sentences_of(text) -> F.Column:
    """The sentences of a text in order, blank ones left out."""
    return F.filter(F.split(text, SENTENCE_END), lambda x: ~x.rlike(r"^\s*$"))


def semantic_split(rows: DataFrame, embed: seams.Embedder, percentile: float = 0.92, around: int = 1) -> DataFrame:
    """Rows (id, text) as (id, part, piece, sentences): texts cut between sentences that are far apart.

    A sentence is embedded with ``around`` neighbours on each side; a piece ends where the cosine
    distance to the next one is over the percentile of the document's distances. A document of one
    sentence is one piece; null and blank texts give none; sentences are joined by a blank. Rows with
    the same id are one document each.
    """
    own = rows.select(F.monotonically_increasing_id().alias("doc_id"), "id", sentences_of(F.col("text")).alias("sentences"))
    held = kept(own, "sentences")  # the ids must not change under the joins below
    groups = semantic(_embedded_sentences(held.select("doc_id", "sentences"), embed, around), percentile)
    spans = groups.groupBy("doc_id", "group").agg(F.min("pos").alias("first"), F.count("*").cast("int").alias("n"))
    pieces = spans.join(held, "doc_id").withColumn("piece", F.array_join(F.slice("sentences", F.col("first") + 1, F.col("n")), " "))
    return pieces.select("id", F.col("group").cast("int").alias("part"), "piece", F.col("n").alias("sentences"))


def _embedded_sentences(held: DataFrame, embed: seams.Embedder, around: int) -> DataFrame:
    """Documents (doc_id, sentences) as (doc_id, pos, embedding), each sentence with its neighbours.

    An embedder whose vectors come of counts adds them up, for documents of simple sentences.
    """
    near = F.transform("sentences", lambda x, i: F.array_join(F.slice("sentences", F.greatest(i - around + 1, F.lit(1)), around + 1 + F.least(i, F.lit(around))), " "))
    each = lambda docs: embed(docs.select("doc_id", F.posexplode(near).alias("pos", "near")), "near").select("doc_id", "pos", "embedding")
    if not hasattr(embed, "near"):
        return each(held)
    simple = F.forall("sentences", tx.is_simple)
    return embed.near(held.where(simple), "sentences", around).unionByName(each(held.where(~simple)))


#: Fixed value: the finer cuts of a sentence that is too long, coarse to fine; characters come last.
FINER = [r"[^,.;，。；、]+[,.;，。；、]?", r"\S+\s*|\s+"]
_SENTENCE = re.compile(r"[^.?!。！？]*[.?!。！？]+[)\]\"'”’»]*\s*|[^.?!。！？]+\Z")


def sentence_pieces(text: str, count, width: int = 500, overlap: int = 80) -> list[str]:
    """Chunks of whole sentences, of at most ``width`` tokens by ``count``.

    A sentence keeps the white space behind it. One that is too long alone is cut at phrases, what is
    still too long at words, then at characters. A new chunk begins with as many of the last pieces of
    the one before as ``overlap`` tokens hold, as long as the next piece still fits. White space at a
    chunk's ends goes; blank chunks are left out.
    """
    if overlap >= width:
        raise ValueError("the overlap must be below the width")
    parts = [(p, count(p)) for s in _SENTENCE.findall(text) for p in _finer(s, count, width, 0)]
    out, held, total = [], [], 0
    for part, n in parts:
        if held and total + n > width:
            out.append("".join(p for p, _ in held))
            while held and (total > overlap or total + n > width):
                total -= held.pop(0)[1]
        held.append((part, n))
        total += n
    out += ["".join(p for p, _ in held)] if held else []
    return [x for x in (c.strip() for c in out) if x]


def _finer(piece: str, count, width: int, level: int) -> list[str]:
    if count(piece) <= width:
        return [piece]
    if level < len(FINER):
        cut = re.findall(FINER[level], piece)
        return [p for x in (cut if "".join(cut) == piece else [piece]) for p in _finer(x, count, width, level + 1)]
    out = [""]
    for c in piece:  # token counts of texts may not add up, so each is counted
        if out[-1] and count(out[-1] + c) > width:
            out.append("")
        out[-1] += c
    return out


def sentence_windows(rows: DataFrame, tokenizer: seams.Tokenizer, width: int = 500, overlap: int = 80) -> DataFrame:
    """Rows (id, text) as (id, part, piece) by ``sentence_pieces``; null and blank texts give none."""

    schema = f"id {dict(rows.dtypes)['id']}, part int, piece string"
    shape = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):  # a batch's pieces aren't held at once
                some = batch.slice(at, _TEXTS)
                found = [sentence_pieces(t, lambda x: len(tokenizer.encode(x)), width, overlap) if t else [] for t in some.column("text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                columns = [some.column("id").take(row), pa.array([i for x in found for i in range(len(x))], pa.int32()), pa.array([p for x in found for p in x], pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    return rows.select("id", "text").mapInArrow(cut, schema)


#: Separators of the recursive splitter, coarse to fine.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", "、", " ", ""]


def split_recursively(text: str, size: int = 500, overlap: int = 80, separators: list[str] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans (start, end) of pieces, cut at the coarsest separator that the text holds; a separator begins the part behind it.

    Parts shorter than ``size`` are put together as long as they fit, and a new piece begins with the
    last parts of the one before, up to ``overlap`` characters. Longer parts are cut by the separators
    that are finer. Nothing is left out: every character is in a span.
    """
    return _spans(text, 0, len(text), size, overlap, separators)


def _spans(text: str, begin: int, end: int, size: int, overlap: int, separators: list[str]) -> list[tuple[int, int]]:
    place = next((i for i, s in enumerate(separators) if not s or text.find(s, begin, end) >= 0), len(separators) - 1)
    mark, finer = separators[place], separators[place + 1 :]
    if mark:
        cuts = [begin, *[m.start() for m in re.compile(re.escape(mark)).finditer(text, begin, end)], end]
    else:
        cuts = list(range(begin, end + 1))
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        if b - a < size:
            held.append((a, b))
            continue
        out += _joined(held, size, overlap)
        held = []
        out += _spans(text, a, b, size, overlap, finer) if finer else [(a, b)]
    return out + _joined(held, size, overlap)


def _joined(parts: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    out, first = [], 0
    for i, (a, b) in enumerate(parts):
        if i > first and b - parts[first][0] > size:
            out.append((parts[first][0], a))
            while first < i and (a - parts[first][0] > overlap or b - parts[first][0] > size):
                first += 1
    return out + ([(parts[first][0], parts[-1][1])] if parts else [])


def recursive_split(rows: DataFrame, size: int = 500, overlap: int = 80, strip: bool = True) -> DataFrame:
    """Rows (id, text) as (id, part, piece) by ``split_recursively``; null and empty texts give none.

    ``strip`` takes white space off the pieces' ends, and leaves blank pieces out.
    """

    def cut(text: str) -> list[str]:
        own = [text[a:b] for a, b in split_recursively(text, size, overlap)]
        return [x for x in (p.strip() for p in own) if x] if strip else own

    @F.pandas_udf("array<string>")
    def pieces(texts):
        return texts.map(lambda t: cut(t) if t else [])

    return rows.select("id", F.posexplode(pieces("text")).alias("part", "piece"))
