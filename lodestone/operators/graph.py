"""The knowledge graph: extraction from documents, matching of names, construction and queries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.routing import DEFAULT_KIND, classify, document_kind
from lodestone.functions.text import OPENING, WIDE_UPPER, heading_level, heading_title, is_heading, let, strip, without_suffix
from lodestone.session import ROWS_PER_TASK, dealt, materialize, ship

# Relations, patterns and lengths.
BELONGS, SIMILAR, TOGETHER = "thuộc_về", "tương_tự", "đồng_xuất_hiện"
DEFINITION = r"(?Ud)^\s*(?:[-*•]|\d+\.)\s+([^:\n]{2,60}?)\s*:\s*(.+)$"
IN_PARENTHESES = r"(?Ud)^(.*?)\s*\(([^)]+)\)\s*$"
PROSE_TAIL = rf"(?U),\s+(?=[^{WIDE_UPPER}])"
MIN_SURFACE = 3
#: A word, or any other character.
TOKEN = re.compile(r"\w+|\W", re.DOTALL)
WORD = re.compile(r"\w")
SAMPLES, NOTE_NAMES = 6, 5

ENTITY = ["key", "name", "kind", "definition", "source_name", "section", "aliases"]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_alias(raw: Column) -> Column:
    """Struct (name, aliases): prose after a comma is cut off, and aliases in parentheses at the end taken apart."""
    none = F.array().cast("array<string>")

    def of_parts(cut: Column, name: Column) -> Column:
        aliases = F.filter(F.transform(F.split(F.regexp_extract(cut, IN_PARENTHESES, 2), "[/,]"), strip), lambda a: F.length(a) >= MIN_SURFACE)
        return F.struct(F.when(name != "", name).otherwise(cut).alias("name"), F.when(name != "", aliases).otherwise(none).alias("aliases"))

    cut = strip(F.get(F.split(strip(raw), PROSE_TAIL, 2), F.lit(0)))
    return let(cut, lambda c: let(strip(F.regexp_extract(c, IN_PARENTHESES, 1)), lambda name: of_parts(c, name)))


def entity_key(source: Column, name: Column) -> Column:
    return F.concat(source, F.lit("#"), F.lower(name))


def extract_mentions_of_definitions(docs: DataFrame) -> DataFrame:
    """Entities before de-duplication, in order: source_name, pos, is_document, after_document, and ENTITY columns.

    The first level-1 heading of a document is an entity of its own; each definition line (a bullet, a name of 2 to 60
    characters, a colon, a text) under a heading gives one, whose kind its section's title decides. Documents are dealt to
    tasks, and lines are exploded within their document: what is read from the whole text is read before, once, as
    beside the lines it would be read again for each. The running section is a window over headings and definitions only.
    """
    dealt = docs.select("source_name", "text").repartition(_partitions(docs), "source_name")
    whole = dealt.select("source_name", document_kind(F.col("text")).alias("_doc_kind"), F.split("text", "\n").alias("_lines"))
    lines = whole.select("source_name", "_doc_kind", F.posexplode("_lines").alias("pos", "line"))
    lines = lines.where(is_heading(F.col("line")) | F.col("line").rlike(DEFINITION))
    lines = lines.withColumns({"_level": heading_level(F.col("line")), "_heading": heading_title(F.col("line"))})
    order = Window.partitionBy("source_name").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    titled = F.min(F.when((F.col("_level") == 1) & (F.col("_heading") != ""), F.col("pos"))).over(Window.partitionBy("source_name"))
    lines = lines.withColumn("_title_at", titled)
    is_title = F.coalesce(F.col("pos") == F.col("_title_at"), F.lit(False))
    section = F.coalesce(F.last_value(F.when((F.col("_level") > 0) & ~is_title, F.col("_heading")), F.lit(True)).over(so_far), F.lit(OPENING))
    lines = lines.withColumns({"is_document": is_title, "section": F.when(is_title, F.col("_heading")).otherwise(section)})
    lines = lines.where("is_document or _level = 0")
    raw = F.when(F.col("is_document"), F.col("_heading")).otherwise(F.regexp_extract("line", DEFINITION, 1))
    lines = lines.withColumn("_split", split_alias(raw))
    return lines.select(
        "source_name",
        "pos",
        "is_document",
        (F.coalesce(F.col("_title_at") < F.col("pos"), F.lit(False))).alias("after_document"),
        entity_key(F.col("source_name"), F.col("_split.name")).alias("key"),
        F.col("_split.name").alias("name"),
        F.when(F.col("is_document"), F.col("_doc_kind")).otherwise(classify(F.col("section"))).alias("kind"),
        F.when(F.col("is_document"), F.lit("")).otherwise(strip(F.regexp_extract("line", DEFINITION, 2))).alias("definition"),
        "section",
        F.col("_split.aliases").alias("aliases"),
    ).where(F.col("is_document") | (F.length("name") >= MIN_SURFACE))


def unique_entities(found: DataFrame) -> DataFrame:
    """One row for each key: the first definition's values, all definitions' aliases in order."""
    first = F.min_by(F.struct("name", "kind", "definition", "source_name", "section", "pos"), "pos").alias("_e")
    aliases = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aliases"))), lambda x: x["aliases"]))).alias("aliases")
    rows = found.groupBy("key").agg(first, aliases)
    return rows.select("key", *(F.col(f"_e.{c}").alias(c) for c in ("name", "kind", "definition", "source_name", "section", "pos")), "aliases")


def belongs_edges(found: DataFrame) -> DataFrame:
    """Edges from each definition after its document's title to the document's entity."""
    docs = found.where("is_document").select("source_name", F.col("key").alias("dst"))
    return found.where("not is_document and after_document").join(docs, "source_name").select(F.col("key").alias("src"), "dst", F.lit(BELONGS).alias("relation"), F.lit(1.0).cast("float").alias("weight"))


def similar_edges(found: DataFrame, kind: str = "kind", source: str = "source_name", order: Sequence[str] = ("source_name", "pos"), key: str = "key", default: str | None = DEFAULT_KIND, at: DataFrame | None = None) -> DataFrame:
    """Edges between entities of one kind and different sources, from the earlier to the later; none of the default kind.

    The pairs of a kind are the result itself, so their number grows with the square of a kind's entities; similar_classes()
    says the same in a row an entity. With at (a column key) only edges with an end among its keys are made, each once.
    found is taken before de-duplication: without at repeated pairs stay, for upsert_edges() to settle.
    """
    rows = found if default is None else found.where(F.col(kind) != default)
    rows = rows.select(F.col(kind).alias("_kind"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.struct(*order).alias("_order"))
    some = rows if at is None else rows.join(at.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.select("_kind", F.col("_key").alias("src"), F.col("_source").alias("_from"), F.col("_order").alias("_a"))
        b = right.select("_kind", F.col("_key").alias("dst"), F.col("_source").alias("_to"), F.col("_order").alias("_b"))
        return a.join(b, "_kind").where((F.col("_a") < F.col("_b")) & (F.col("_from") != F.col("_to"))).select("src", "dst")

    every = pairs(some, rows) if at is None else pairs(some, rows).union(pairs(rows, some)).distinct()
    return every.select("src", "dst", F.lit(SIMILAR).alias("relation"), F.lit(1.0).cast("float").alias("weight"))


def similar_classes(found: DataFrame, kind: str = "kind", source: str = "source_name", key: str = "key", default: str | None = DEFAULT_KIND) -> DataFrame:
    """similar_edges() without listing pairs: key, kind, source_name, links of each entity.

    Entities of one kind and source are a class; an entity's edges go to the kind's entities of all other classes, and
    links counts them. Classes are counted before they are shuffled, and no kind's pairs are formed.
    """
    rows = found if default is None else found.where(F.col(kind) != default)
    sizes = rows.groupBy(F.col(kind).alias("_kind"), F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    whole = sizes.groupBy("_kind").agg(F.sum("_n").alias("_all"))
    classes = sizes.join(whole, "_kind").select("_kind", "_source", (F.col("_all") - F.col("_n")).alias("links"))
    joined = rows.join(classes, (F.col(kind) == F.col("_kind")) & (F.col(source) == F.col("_source")))
    return joined.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(source).alias("source_name"), "links")


def similar_members(found: DataFrame, default: str | None = DEFAULT_KIND) -> DataFrame:
    """similar_edges() as a factorised table: key, role, source_name, n, a row for each kind (role) that defines a key, n times.

    Members of one role and different sources are similar; nothing else needs to be stored.
    """
    rows = found if default is None else found.where(F.col("kind") != default)
    return rows.groupBy("key", F.col("kind").alias("role"), "source_name").agg(F.count("*").alias("n"))


def similar_counts(members: DataFrame) -> DataFrame:
    """One row: edges, how many similar_edges() finds, and stored_edges, how many are left when repeated ones are settled.

    Pairs of different sources are all pairs less those within a source. A key of several roles could count twice for
    a pair, so stored edges are counted over profiles, the sets of roles of a key: within a profile, and between two
    that share a role. Only sums over (role, source) and (profile, source) are joined.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")

    def within(sizes: DataFrame, by: str) -> DataFrame:
        sums = sizes.groupBy(by).agg(F.sum(big("c")).alias("s"), F.sum(big("c") * big("c")).alias("q"))
        return sums.select(((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"))

    found = within(members.groupBy("role", "source_name").agg(F.sum("n").alias("c")), "role")
    profiles = members.groupBy("key", "source_name").agg(F.array_sort(F.collect_set("role")).alias("p"))
    sizes = materialize(profiles.groupBy("p", "source_name").agg(F.count("*").alias("c")))
    whole = sizes.groupBy("p").agg(F.sum(big("c")).alias("s"))
    roles = whole.select("p", F.explode("p").alias("role"))
    both = roles.join(roles.withColumnRenamed("p", "q"), "role").where("p < q").select("p", "q").distinct()
    each = both.join(whole, "p").join(whole.select(F.col("p").alias("q"), F.col("s").alias("t")), "q")
    shared = both.join(sizes, "p").join(sizes.select(F.col("p").alias("q"), "source_name", F.col("c").alias("d")), ["q", "source_name"]).select((big("c") * big("d")).alias("pairs"))
    stored = within(sizes, "p").union(each.select(F.col("s") * F.col("t"))).union(shared.select(-F.col("pairs")))
    return found.agg(total("pairs").alias("edges")).crossJoin(stored.agg(total("pairs").alias("stored_edges")))


def together_by_class(mentions: DataFrame, once: bool = False) -> DataFrame:
    """together_edges() of mentions (entity_key, chunk_id) where many entities have the same chunks, as those of one name.

    once says that no mention repeats another, so that none is shuffled to see whether it does.

    Entities with equal chunks make a class, told by their number and two 64-bit hashes; chunks are only joined on
    classes, and the pairs of two classes' entities have the classes' weight.
    """
    hashes = [F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)")).alias("_x"), F.bit_xor(F.xxhash64("chunk_id", F.lit(1))).alias("_y")]
    mentions = mentions if once else mentions.distinct()
    same = materialize(mentions.groupBy("entity_key").agg(F.count("*").alias("_w"), *hashes))
    members = same.select("entity_key", F.concat_ws(" ", "_w", "_x", "_y").alias("_class"))
    first = members.groupBy("_class").agg(F.min("entity_key").alias("entity_key"))
    few = mentions.join(first, "entity_key").select("_class", "chunk_id")
    shared = together_edges(few, "_class", "chunk_id").select("src", "dst", "weight")
    own = same.select(F.concat_ws(" ", "_w", "_x", "_y").alias("src"), F.concat_ws(" ", "_w", "_x", "_y").alias("dst"), F.col("_w").cast("float").alias("weight")).distinct()
    a, b = (members.select(F.col("_class").alias(c), F.col("entity_key").alias(k)) for c, k in (("src", "_a"), ("dst", "_b")))
    pairs = shared.unionByName(own).join(a, "src").join(b, "dst").where("src <> dst or _a < _b")
    return pairs.select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), F.lit(TOGETHER).alias("relation"), "weight")


#: Entities of a chunk beyond which its pairs are made in a grid of blocks of about so many.
HEAVY = 1000


def together_edges(mentions: DataFrame, entity: str = "entity_key", chunk: str = "chunk_id", heavy: int = HEAVY) -> DataFrame:
    """Edges between entities (a < b) that chunks mention together, weighted by the number of those chunks.

    A chunk's entities meet in a join on the chunk. Where there are more than heavy of them they are dealt to blocks by
    hash, and meet in a join on (chunk, block, block): no key of that has more than about two blocks of rows, however
    many entities a chunk has, and blocks of one chunk spread over tasks. Mentions are written and pairs counted first, so that
    a task's share doesn't grow. Where pairs must repeat, edges are counted in each task before they are shuffled.
    """
    seen = mentions.select(F.col(entity).alias("_e"), F.col(chunk).alias("_c")).distinct()
    seen = materialize(seen)
    rows = seen.count()
    sizes = dealt(seen.select("_c"), rows, "_c").groupBy("_c").agg(F.count("*").cast("double").alias("_n"))
    pairs, most = sizes.agg(F.coalesce(F.sum(F.col("_n") * (F.col("_n") - 1) / 2), F.lit(0.0)), F.coalesce(F.max("_n"), F.lit(0.0))).first()
    share = max(rows, int(pairs))
    if most <= heavy:
        near = dealt(seen, share, "_c")
        met = near.join(near.select("_c", F.col("_e").alias("_f")), "_c").where("_e < _f")
    else:
        large = sizes.where(F.col("_n") > heavy).select(F.col("_c").alias("_of"), F.ceil(F.col("_n") / heavy).cast("int").alias("_blocks"))
        spread = seen.join(large, F.col("_c") == F.col("_of"), "left").withColumn("_b", F.pmod(F.xxhash64("_e"), F.coalesce("_blocks", F.lit(1))).cast("int")).drop("_of")
        last = F.coalesce("_blocks", F.lit(1)) - 1
        low = spread.select("_c", "_e", F.col("_b").alias("_i"), F.explode(F.sequence("_b", last)).alias("_j"))
        high = spread.select("_c", F.col("_e").alias("_f"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
        keys = ["_c", "_i", "_j"]
        # within a block each pair is met twice, between two blocks once
        met = dealt(low, share, *keys).join(dealt(high, share, *keys), keys).where("_e <> _f and (_i < _j or _e < _f)")
    edges = met.select(F.least("_e", "_f").alias("src"), F.greatest("_e", "_f").alias("dst"))
    repeated = pairs > ROWS_PER_TASK and pairs > seen.agg(F.approx_count_distinct("_e")).first()[0] ** 2
    edges = edges if repeated else dealt(edges, share, "src", "dst")
    return edges.groupBy("src", "dst").agg(F.count("*").cast("float").alias("weight")).select("src", "dst", F.lit(TOGETHER).alias("relation"), "weight")


def upsert_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge for each (src, dst, relation). Of edges that repeat one the last by order gives the weight, without order the heaviest."""
    weight = F.max("weight") if order is None else F.max_by("weight", order)
    return edges.groupBy("src", "dst", "relation").agg(weight.alias("weight"))


def load_lexicon(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities (id, ...) with the sorted aliases of each (entity_id, alias), empty without any."""
    each = aliases.where("alias is not null").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return entities.join(each, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def surfaces(entities: DataFrame) -> DataFrame:
    """surface, key, name, pos: each name and alias of three characters or more in lower case, with its entity.

    Within a surface entities keep their order by source, pos; the same spelling twice in one entity gives two rows.
    """
    rows = entities.select("key", "name", "source_name", "pos", F.posexplode(F.concat(F.array("name"), "aliases")).alias("nth", "_s"))
    return rows.where(F.length("_s") >= MIN_SURFACE).select(F.lower("_s").alias("surface"), "key", "name", "source_name", "pos", "nth")


@lru_cache(1 << 16)
def _fold(c: str) -> str:
    """One character for all that may equal c when case is ignored, also where a letter has more than one lower-case form.

    Where upper case is several characters, as of a ligature, a character of a private plane stands for them.
    """
    upper = c.lower()[0].upper()
    return upper.lower()[0] if len(upper) == 1 else chr(0xF0000 + zlib.crc32(upper.encode()) % 0xFFFE)


def folded(text: str) -> str:
    """text with each character folded; it has the same length."""
    return text.lower() if text.isascii() else "".join(map(_fold, text))


def _equal(surface: str, said: str) -> bool:
    return said.lower() == surface or bool(re.fullmatch(re.escape(surface), said, re.IGNORECASE))


def settle(found: Iterable[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of candidates (rank, start, end, surface) of one text those that are accepted, by place.

    The best rank comes first, wherever it stands, and no accepted match is overlapped. A surface is looked for from the end of its
    match before, accepted or not, so its own matches don't overlap either.
    """
    taken: list[tuple[int, int, str]] = []
    filled = bytearray(max((m[2] for m in found), default=0))
    before, end = -1, 0
    for rank, a, b, s in sorted(found):
        if rank == before and a < end:
            continue
        before, end = rank, b
        if filled.find(1, a, b) < 0:
            filled[a:b] = b"\1" * (b - a)
            taken.append((a, b, s))
    return sorted(taken, key=lambda x: (x[0], x[2]))


class Matcher:
    """Longest-first matching of surfaces in a text: by length, then in the order given; no accepted match is overlapped.

    The longest surface wins wherever it stands, even over one that starts further left. A surface stands between
    characters that aren't word characters; case is ignored. An automaton over folded characters finds all surfaces in
    one pass, so time is in proportion to the text and its matches, however many surfaces there are.
    """

    def __init__(self, ordered: Sequence[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        alike: dict[str, list[tuple[int, str]]] = {}
        for rank, s in enumerate(sorted(ordered, key=len, reverse=True)):
            if s:
                alike.setdefault(folded(s), []).append((rank, s))
        for key, some in alike.items():
            self.automaton.add_word(key, some)
        if alike:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[tuple[int, int, int, str]]:
        """(rank, start, end, surface) of every match, whether others overlap it or not."""
        found = []
        for last, some in self.automaton.iter(folded(text)) if len(self.automaton) else ():
            start, end = last + 1 - len(some[0][1]), last + 1
            if not (start and WORD.match(text, start - 1)) and not WORD.match(text, end):
                found += [(rank, start, end, s) for rank, s in some if _equal(s, text[start:end])]
        return found

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        return settle(self.candidates(text))


def _matches(column: pa.Array, found: list[list[tuple[int, int, str]]], key: str) -> pa.RecordBatch:
    """Each text's matches in order, under its key."""
    rows = [(i, nth, *m) for i, each in enumerate(found) for nth, m in enumerate(each)]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    at, *values = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))
    return pa.RecordBatch.from_arrays([column.take(at), *values], names=[key, "nth", "start", "end", "surface"])


#: Surfaces that are sent to every task at most; texts meet a larger lexicon in a join.
MAX_LEXICON = 200_000
#: Bits of the filter that text passes before such a join, and buckets of first words, by hash.
FILTER_BITS, FIRST_WORDS = 1 << 27, 1 << 16


def _hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


class Surfaces:
    """A lexicon's distinct surfaces, made ready once for any number of match_surfaces().

    Up to MAX_LEXICON of them, counted first, are sent to all tasks as a list. Of a larger lexicon each surface has a
    hash of its folded characters. Texts and surfaces meet by that hash; so that few pieces of text travel, all tasks get
    a filter of FILTER_BITS bits, and which lengths surfaces have whose first word falls in a bucket. Both are bounded,
    and only spare work: what they let pass wrongly finds no partner.
    """

    def __init__(self, lexicon: DataFrame) -> None:
        self.spark = lexicon.sparkSession
        ship(self.spark)
        first = lexicon.groupBy("surface").agg(F.min(F.struct("source_name", "pos", "nth")).alias("_first"))
        first = materialize(first)
        self.small = first.count() <= MAX_LEXICON
        if self.small:
            few = [r["surface"] for r in first.orderBy("_first", "surface").select("surface").collect()]
            self.sent = self.spark.sparkContext.broadcast(few)
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [folded(s) for s in batch.column(0).to_pylist()]
                starts = [_hashed(TOKEN.match(k)[0]) % FIRST_WORDS if k else 0 for k in keys]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in (([_hashed(k) for k in keys], pa.int64()), (starts, pa.int32()), (list(map(len, keys)), pa.int32())))], names=["surface", "_first", "_hash", "_start", "_length"])

        self.rows = materialize(first.where("surface <> ''").mapInArrow(run, f"surface string, _first {first.schema['_first'].dataType.simpleString()}, _hash long, _start int, _length int"))
        bit = F.pmod("_hash", F.lit(FILTER_BITS))
        words = self.rows.groupBy(F.floor(bit / 8).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))).alias("bits")).toArrow()
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        bits[words["at"].to_numpy()] = words["bits"].to_numpy()
        lengths: dict[int, list[int]] = {}
        for start, length in self.rows.select("_start", "_length").distinct().collect():
            lengths.setdefault(start, []).append(length)
        self.sent = self.spark.sparkContext.broadcast((bits.tobytes(), lengths))


def match_surfaces(texts: DataFrame, lexicon: DataFrame | Surfaces, key: str, text: str) -> DataFrame:
    """key, nth, start, end, surface of each match of the lexicon's distinct surfaces in each text, in order.

    A lexicon that several calls share is best given as Surfaces. Null texts have no matches. For a lexicon that is too
    large to be sent, key must be unique: a text's candidates come together under it.
    """
    ready = lexicon if isinstance(lexicon, Surfaces) else Surfaces(lexicon)
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, nth int, start int, end int, surface string"
    sent = ready.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(sent.value)
        for batch in batches:
            yield _matches(batch.column(0), [match(t.as_py() or "") for t in batch.column(1)], key)

    return texts.select(key, text).mapInArrow(run, schema) if ready.small else _joined(texts, ready, key, text, schema)


def _joined(texts: DataFrame, ready: Surfaces, key: str, text: str, schema: str) -> DataFrame:
    """match_surfaces() by a join. A match starts and ends where a token of the text does, so only such pieces are hashed."""
    kind, sent = texts.schema[key].dataType.simpleString(), ready.sent

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = sent.value
        asked = lru_cache(1 << 16)(lambda word: lengths.get(_hashed(word) % FIRST_WORDS, ()))
        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column(1)):
                said = value.as_py() or ""
                like = folded(said)
                ends = {m.end() for m in TOKEN.finditer(said)}
                for m in TOKEN.finditer(like):
                    a = m.start()
                    if a and WORD.match(said, a - 1):
                        continue
                    for n in asked(m[0]):
                        b = a + n
                        if b in ends and not WORD.match(said, b):
                            h = _hashed(like[a:b])
                            if bits[h % FILTER_BITS // 8] >> h % FILTER_BITS % 8 & 1:
                                rows.append((i, a, b, h, said[a:b]))
            at, *values = (pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *values], names=[key, "start", "end", "_hash", "said"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for each in batch.column(1).to_pylist():
                rank = {s: k for k, s in enumerate(dict.fromkeys(m["surface"] for m in each))}
                found.append(settle([(rank[m["surface"]], m["start"], m["end"], m["surface"]) for m in each if _equal(m["surface"], m["said"])]))
            yield _matches(batch.column(0), found, key)

    candidates = texts.select(key, text).mapInArrow(pieces, f"{key} {kind}, start int, end int, _hash long, said string")
    order = F.struct((-F.length("surface")).alias("_length"), "_first", "surface", "start", "end", "said")
    each = candidates.join(ready.rows.select("surface", "_first", "_hash"), "_hash").groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("_m"))
    return each.select(key, F.transform("_m", lambda m: F.struct(*(m[c].alias(c) for c in ("surface", "start", "end", "said")))).alias("_m")).mapInArrow(settled, schema)


def found_entities(matches: DataFrame, lexicon: DataFrame, key: str, by: str = "name") -> DataFrame:
    """key, names: each text's distinct entity names (or keys), in the order of their first match."""
    rows = matches.join(lexicon.withColumnRenamed("nth", "_alias"), "surface")
    place = F.struct("nth", "source_name", "pos", "_alias")
    first = rows.groupBy(key, by).agg(F.min(place).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", by))), lambda x: x[by]).alias(f"{by}s"))


def mentions(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """entity_key, chunk_id of every entity, of any source, one of whose surfaces a chunk (id, content) has; each once.

    Chunks are dealt to tasks before, as they come from few documents where those are long. Surfaces that say the same
    keys are one class, and a chunk gathers its classes. Where classes are few enough to be sent, rows leave the task that
    makes them: of a chunk's classes that say a key, the first gives its row. Otherwise classes meet their keys in a join,
    and repeated rows are settled by a shuffle.
    """
    matches = match_surfaces(chunks.select("id", "content").repartition(_partitions(chunks), "id"), lexicon, "id", "content")
    of_surface = materialize(lexicon.groupBy("surface").agg(F.array_sort(F.collect_set("key")).alias("_keys")))
    classes = materialize(of_surface.select("_keys").distinct().withColumn("_class", F.monotonically_increasing_id()))
    found = matches.select(F.col("id").alias("chunk_id"), "surface").distinct().join(of_surface.join(classes, "_keys").select("surface", "_class"), "surface")
    said = classes.select("_class", F.explode("_keys").alias("entity_key"), F.struct((-F.size("_keys")).alias("n"), F.col("_class").alias("c")).alias("_at"))
    pairs = F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))
    if said.groupBy("entity_key").agg(F.count("*").alias("n")).agg(pairs).first()[0] > MAX_LEXICON:
        return found.select("chunk_id", "_class").distinct().join(said, "_class").select("entity_key", "chunk_id").distinct()
    ranked = said.groupBy("entity_key").agg(F.array_sort(F.collect_list("_at")).alias("_all")).select("entity_key", F.posexplode("_all").alias("_nth", "_at"), "_all")
    before = F.transform(F.slice("_all", F.lit(1), F.col("_nth")), lambda x: x["c"]).alias("_before")
    sent = F.broadcast(ranked.select(F.col("_at.c").alias("_class"), "entity_key", before))
    each = found.groupBy("chunk_id").agg(F.collect_set("_class").alias("_in")).withColumn("_class", F.explode("_in"))
    return each.join(sent, "_class").where((F.size("_before") == 0) | ~F.arrays_overlap("_before", "_in")).select("entity_key", "chunk_id")


#: What build_graph() makes, each after what it needs.
GRAPH_TABLES = ("entities", "aliases", "similar", "mentions", "edges", "counts")


def build_graph(docs: DataFrame, chunks: DataFrame, tables: Sequence[str] = GRAPH_TABLES) -> dict[str, DataFrame]:
    """Tables entities, aliases, mentions, edges, similar of documents (source_name, text) and chunks (id, content), and counts.

    edges lists what belongs to a document and what stands together; similar has the edges between entities of one kind
    as similar_members(), since their pairs grow with the square of a kind. counts has one row: edges counts all edges
    as they are found, stored_edges after repeated ones are settled. Definitions, entities, mentions and edges are written before they are reused.
    Where only some tables are asked for, later steps than theirs are left out.
    """
    upto = max(map(GRAPH_TABLES.index, tables))
    found = materialize(extract_mentions_of_definitions(docs))
    similar = materialize(similar_members(found))
    entities = unique_entities(found) if upto < GRAPH_TABLES.index("mentions") else materialize(unique_entities(found))
    aliases = entities.select("key", F.explode("aliases").alias("alias")).distinct()
    built = {"entities": entities, "aliases": aliases, "similar": similar}
    if upto < GRAPH_TABLES.index("mentions"):
        return built
    mentioned = materialize(mentions(chunks, surfaces(entities)))
    built["mentions"] = mentioned
    if upto < GRAPH_TABLES.index("edges"):
        return built
    belongs = belongs_edges(found)
    edges = materialize(upsert_edges(belongs.unionByName(together_by_class(mentioned, once=True))))
    built["edges"] = edges
    if upto < GRAPH_TABLES.index("counts"):
        return built
    one = lambda df, name: df.agg(F.count("*").alias(name))
    repeated = one(belongs, "_all").crossJoin(one(edges.where(F.col("relation") == BELONGS), "_once")).select((F.col("_all") - F.col("_once")).alias("_more"))
    listed = similar_counts(similar).select(F.col("edges").alias("_found"), F.col("stored_edges").alias("_stored"))
    counts = one(entities, "entities").crossJoin(entities.agg(F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases"))).crossJoin(one(mentioned, "mentions")).crossJoin(one(edges, "_edges")).crossJoin(repeated).crossJoin(listed)
    counts = counts.select("entities", "aliases", "mentions", F.expr("_edges + _more + _found").alias("edges"), F.expr("_edges + _stored").alias("stored_edges"))
    return built | {"counts": counts}


def histogram(rows: DataFrame, by: str) -> DataFrame:
    """by, n: how many rows have each value."""
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def neighbors(edges: DataFrame, entities: DataFrame, seeds: DataFrame, relations: Sequence[str] = (SIMILAR,)) -> DataFrame:
    """qid, name, source_name, kind, relation, weight, from_name: entities one edge from each question's seeds, either way.

    seeds has (qid, name); names are matched as they are, in all sources, and rows whose name is a seed of the question
    are left out. Only edges at a seed are looked at: seeds find their entities, these their edges.
    """
    chosen = edges.where(F.col("relation").isin(*relations))
    ends = entities.select("key", "name", "source_name", "kind")
    starts = seeds.select("qid", F.col("name").alias("from_name")).distinct().join(ends.select(F.col("key").alias("_key"), F.col("name").alias("from_name")), "from_name")

    def step(a: str, b: str) -> DataFrame:
        near = starts.join(chosen, F.col("_key") == F.col(a)).select("qid", "from_name", F.col(b).alias("key"), "relation", "weight")
        return near.join(ends, "key").select("qid", "name", "source_name", "kind", "relation", "weight", "from_name")

    both = step("src", "dst").union(step("dst", "src")).distinct()
    return both.join(seeds.select("qid", "name").distinct(), ["qid", "name"], "left_anti")


def _named(members: DataFrame, entities: DataFrame) -> DataFrame:
    """role, name, source_name, kind of the members, each once."""
    return members.select("key", "role").join(entities.select("key", "name", "source_name", "kind"), "key").drop("key").distinct()


def similar_to(members: DataFrame, entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """What similar edges lead to from each question's seeds (qid, name), without listing it: qid, from_name, role, without.

    A seed's entities, of any source, are near the members of their role that other sources have. without is the source
    whose members don't count, as all of the seed's entities in that role are of it; null where there are two sources,
    so that each leads to the other's. The question's own seeds never count.
    """
    own = seeds.select("qid", F.col("name").alias("from_name")).distinct().join(_named(members, entities).withColumnRenamed("name", "from_name"), "from_name")
    least, most = F.min("source_name"), F.max("source_name")
    return own.groupBy("qid", "from_name", "role").agg(F.when(least == most, least).alias("without"))


def _is_near(source: str = "source_name") -> Column:
    return F.col("without").isNull() | (F.col(source) != F.col("without"))


#: A role's members make lists of at most about BLOCK names, which are dealt to at most so many blocks.
BLOCKS, BLOCK = 32, 1000


def similar_neighbors(members: DataFrame, entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """neighbors() over similar edges: the rows of what similar_to() says, which are as many as there are neighbours.

    Rows leave the task that makes them; none is shuffled, sorted or compared with another. A seed carries its question's
    seeds and, by role, what similar_to() says. Neighbours of one source, kind and set of roles are alike to a seed, so their
    names are a list: seeds meet lists, of which those stay that are near and whose first near role is the one they
    met by, and only then are names taken out. A role's lists are dealt to blocks, each of which meets all of the
    role's seeds, so that what is shuffled grows with the seeds and the members alone.
    """
    own = seeds.groupBy("qid").agg(F.collect_set("name").alias("_own"))
    said = materialize(similar_to(members, entities, seeds))
    near = said.groupBy("qid", "from_name").agg(F.collect_list(F.struct("role", "without")).alias("_roles")).join(own, "qid")
    near = near.select("qid", "from_name", "_own", "_roles", F.explode("_roles").alias("_r")).select("qid", "from_name", "_own", "_roles", "_r.role", "_r.without")
    named = materialize(_named(members, entities).groupBy("name", "source_name", "kind").agg(F.array_sort(F.collect_set("role")).alias("_in")))
    alike = ["source_name", "kind", "_in"]
    sizes = named.groupBy(*alike).agg(F.ceil(F.count("*") / BLOCK).alias("_lists"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike))
    parts = named.join(sizes.withColumnsRenamed({c: f"_{c}" for c in alike}), same).withColumn("_part", F.pmod(F.xxhash64("name"), F.col("_lists")))
    nameless = F.array_repeat(F.lit(None).cast(named.schema["name"].dataType), (F.count("*") - F.count("name")).cast("int"))
    lists = parts.groupBy(*alike, "_part").agg(F.concat(F.collect_list("name"), nameless).alias("_names"))
    lists = lists.withColumn("_block", F.pmod(F.xxhash64("source_name", "kind", "_part"), F.lit(BLOCKS)).cast("int"))
    high = materialize(lists.drop("_part").withColumn("role", F.explode("_in")))
    low = near.join(high.select("role", "_block").distinct(), "role")
    keys, n = ["role", "_block"], _partitions(members)
    met = low.repartition(n, *keys).join(high.repartition(n, *keys).hint("shuffle_hash"), keys)
    first = F.filter("_in", lambda r: F.exists("_roles", lambda x: (x["role"] == r) & (x["without"].isNull() | (F.col("source_name") != x["without"]))))
    met = met.where(_is_near() & ((F.size("_in") == 1) | (F.get(first, F.lit(0)) == F.col("role"))))
    rows = met.select("qid", "from_name", "_own", "source_name", "kind", F.explode("_names").alias("name")).where(~F.coalesce(F.array_contains("_own", F.col("name")), F.lit(False)))
    return rows.select("qid", "name", "source_name", "kind", F.lit(SIMILAR).alias("relation"), F.lit(1.0).cast("float").alias("weight"), "from_name")


def similar_notes(members: DataFrame, entities: DataFrame, seeds: DataFrame, names: int = NOTE_NAMES) -> DataFrame:
    """relation_notes(similar_neighbors()) from each role's first names alone.

    The first names that a seed is near are among the first of its role when names of its own source and the question's
    seeds are passed over. As many names are taken of each role and source as any question may have to pass over, besides
    those it needs, and twice as many of the role; questions meet these only.
    """
    labelled = _named(members, entities).withColumn("label", _label())
    own = seeds.select("qid", "name").distinct()
    passed = own.join(labelled, "name").groupBy("qid", "role", "kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    of_source = Window.partitionBy("role", "kind", "source_name").orderBy("label", "name")
    of_role = Window.partitionBy("role", "kind").orderBy("label")
    first = labelled.withColumn("_nth", F.row_number().over(of_source)).where(F.col("_nth") <= names + passed)
    first = first.withColumn("_nth", F.dense_rank().over(of_role)).where(F.col("_nth") <= 2 * (names + passed)).drop("_nth")
    near = similar_to(members, entities, seeds).join(first, "role").where(_is_near()).join(own, ["qid", "name"], "left_anti")
    return relation_notes(near)


def _profiles(named: DataFrame, keys: DataFrame, mentioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (group, in), the sets of roles that names have, and each chunk's profile: how many of its entities have a name of which group.

    Both are written. A mention is shuffled to its entity and to its chunk, as two numbers.
    """
    of_name = named.groupBy("name").agg(F.array_sort(F.collect_set("role")).alias("in"))
    groups = materialize(of_name.select("in").distinct().withColumn("group", F.monotonically_increasing_id()))
    of_key = keys.join(of_name, "name").join(groups, "in").select("entity_key", "group")
    met = mentioned.join(of_key.hint("shuffle_hash"), "entity_key").select("chunk_id", "group")
    counted = dealt(met, mentioned.count(), "chunk_id").groupBy("chunk_id", "group").agg(F.count("*").alias("n"))
    return groups, materialize(counted.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("group", "n"))).alias("profile")))


def expand_similar(members: DataFrame, entities: DataFrame, mentioned: DataFrame, seeds: DataFrame, hits: DataFrame, limit: int, depth: int = 64) -> DataFrame:
    """expand(similar_neighbors()) without a row for each neighbour or each chunk of a question.

    A chunk's count for a question is at most the number of its entities whose name has one of the question's roles,
    which depends on the set of roles and the chunk's profile alone. So a set of roles ranks profiles by that bound, and
    takes chunks only of the best, until it has depth. What these mention is counted exactly once for all questions that
    similar_to() says the same of; a question takes off what has its own seeds' names, and leaves out its hits. It is
    settled if its limit-th chunk comes before whatever lies behind the depth, or nothing does. Others are asked again,
    eight times as deep, until none is left. mentioned is read in each step, so it is best written before.
    """
    named = materialize(_named(members, entities).select("role", "name", "source_name").distinct())
    near = materialize(similar_to(members, entities, seeds))
    keys = entities.select("name", F.col("key").alias("entity_key"))
    pending = materialize(near.groupBy("qid").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set(F.struct("role", "without"))).alias("sides")))
    sets = pending.select("roles").distinct().select("roles", F.explode("roles").alias("role"))
    groups, profiles = _profiles(named.join(sets.select("role").distinct(), "role", "left_semi"), keys, mentioned)
    in_set = groups.select("group", F.explode("in").alias("role")).join(sets, "role").select("group", "roles").distinct()
    each = profiles.groupBy("profile").agg(F.count("*").alias("chunks")).select("profile", "chunks", F.explode("profile").alias("_p")).select("profile", "chunks", "_p.group", "_p.n")
    bound = materialize(each.join(in_set, "group").groupBy("roles", "profile").agg(F.sum("n").alias("most"), F.max("chunks").alias("chunks")))
    own, known = seeds.select("qid", "name").distinct(), hits.select("qid", F.col("id").alias("chunk_id")).distinct()
    better = Window.partitionBy("roles").orderBy(F.desc("most")).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("roles").orderBy(F.desc("most"), "chunk_id")
    best = Window.partitionBy("qid").orderBy(F.desc("n"), "chunk_id")
    counts = F.exists("sides", lambda x: (x["role"] == F.col("role")) & (x["without"].isNull() | (F.col("source_name") != x["without"])))
    settled = []
    while True:
        levels = bound.join(pending.select("roles").distinct(), "roles", "left_semi").groupBy("roles", "most").agg(F.sum("chunks").alias("_chunks"))
        levels = levels.withColumn("_before", F.coalesce(F.sum("_chunks").over(better), F.lit(0))).where(F.col("_before") < depth)
        taken = materialize(bound.join(levels, ["roles", "most"]).select("roles", "profile", "most"))
        top = materialize(profiles.join(taken, "profile").select("roles", "chunk_id", "most").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= depth))
        last = top.where(F.col("_nth") == depth).select("roles", F.col("most").alias("_most"), F.col("chunk_id").alias("_last"))
        chunks = top.select("chunk_id").distinct()
        met = materialize(mentioned.join(chunks, "chunk_id").select("chunk_id", "entity_key"))
        said = materialize(met.join(keys, "entity_key").join(named, "name"))
        lists = pending.select("roles", "sides").distinct().join(top.select("roles", "chunk_id"), "roles").select("sides", "chunk_id")
        counted = materialize(lists.join(said, "chunk_id").where(counts).groupBy("sides", "chunk_id").agg(F.count_distinct("entity_key").alias("_all")))
        less = pending.select("qid", "sides").join(own, "qid").join(said, "name").where(counts).groupBy("qid", "chunk_id").agg(F.count_distinct("entity_key").alias("_less"))
        less = less.withColumn("_known", F.lit(False)).unionByName(known.join(chunks, "chunk_id", "left_semi").select("qid", "chunk_id", F.lit(0).cast("long").alias("_less"), F.lit(True).alias("_known")))
        less = materialize(less.groupBy("qid", "chunk_id").agg(F.sum("_less").alias("_less"), F.max("_known").alias("_known")))
        chosen = pending.join(counted, "sides").join(less, ["qid", "chunk_id"], "left").where(F.col("_known").isNull() | ~F.col("_known"))
        chosen = chosen.select("qid", "chunk_id", (F.col("_all") - F.coalesce("_less", F.lit(0))).alias("n")).where("n > 0")
        found = chosen.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)
        behind = pending.join(last, "roles", "left").select("qid", "_most", "_last")
        found = materialize(behind.join(found, "qid", "left"))
        ends = F.max(F.when(F.col("position") == limit, F.struct("n", "chunk_id")))
        done = found.groupBy("qid").agg(F.first("_most").alias("_most"), F.first("_last").alias("_last"), ends.alias("_end"))
        enough = F.col("_end.n").isNotNull() & ((F.col("_end.n") > F.col("_most")) | ((F.col("_end.n") == F.col("_most")) & (F.col("_end.chunk_id") <= F.col("_last"))))
        done = done.where(F.col("_most").isNull() | enough).select("qid")
        settled.append(found.join(done, "qid", "left_semi").where("position is not null").select("qid", "chunk_id", "position"))
        pending = materialize(pending.join(done, "qid", "left_anti"))
        if not pending.count():
            return reduce(DataFrame.union, settled)
        depth *= 8


def chunks_mentioning(mentioned: DataFrame, entities: DataFrame, names: DataFrame, limit: int | None = 3, without: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, n, rank: the chunks that mention most entities of each question's names, ties by chunk_id.

    n counts entities, so one name that several sources have counts as often. Chunks of without (qid, chunk_id) are left
    out first. The limit, if any, applies in each partition before ranks are shuffled; with None all are given, without rank.
    """
    wanted = names.select("qid", "name").distinct().join(entities.select("name", F.col("key").alias("entity_key")), "name")
    counted = wanted.join(mentioned, "entity_key").groupBy("qid", "chunk_id").agg(F.count("*").alias("n"))
    if without is not None:
        counted = counted.join(without, ["qid", "chunk_id"], "left_anti")
    if limit is None:
        return counted
    order = Window.partitionBy("qid").orderBy(F.desc("n"), "chunk_id")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def communities(entities: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """source_name, n, kinds, samples: each source's entities, sorted kinds, and names with the longest definitions.

    Only the samples of each source are gathered: a rank limits them before.
    """
    order = Window.partitionBy("source_name").orderBy(F.desc(F.length("definition")), "name")
    best = entities.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= samples)
    names = best.groupBy("source_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "name"))), lambda x: x["name"]).alias("samples"))
    counts = entities.groupBy("source_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return counts.join(names, "source_name").select("source_name", "n", "kinds", "samples")


def _label() -> Column:
    return F.concat(F.col("name"), F.lit(" ("), without_suffix(F.col("source_name")), F.lit(")"))


def relation_notes(near: DataFrame) -> DataFrame:
    """qid, notes: for each seed and kind a sentence with the first five of its neighbours, sorted by seed and kind."""
    each = near.groupBy("qid", "from_name", "kind").agg(F.slice(F.array_sort(F.collect_set(_label())), 1, NOTE_NAMES).alias("_to"))
    note = F.concat(F.col("from_name"), F.lit(' cùng vai trò "'), F.col("kind"), F.lit('" với: '), F.array_join("_to", ", "))
    return each.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("from_name", "kind", note.alias("note")))), lambda x: x["note"]).alias("notes"))


def expand(near: DataFrame, mentioned: DataFrame, entities: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """qid, chunk_id, position: up to limit chunks of each question's neighbours that its hits (qid, id) haven't."""
    known = hits.select("qid", F.col("id").alias("chunk_id")).distinct()
    return chunks_mentioning(mentioned, entities, near, limit, known).select("qid", "chunk_id", F.col("rank").alias("position"))
