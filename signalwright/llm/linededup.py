"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Each line is hashed, and a hash rolls over the line hashes with a window of one line; where it lies in the lower SHARE of its range, the line
ends a chunk and begins the next. So a border depends on its own line alone, and a passage shared by two documents falls into the same
chunks wherever it stands in them: with a wider window, or by comparison with the neighbours, its first and last lines would depend on
what stands around it. Three such chunkings, by three mixes of the line hashes, catch what one of them cuts at the ends of a short passage.
A chunk that occurs again, in the same or another document, is repeated; its lines are removed everywhere but at its first place (the
smallest doc_id, then the first line), and the lines of a first place stay, whatever other chunk holds them. A removed line thus has an equal
one at an earlier place, and every repeated chunk stays whole once.

Chunks are counted by a hash, so that texts don't travel for that. The documents that hold repeated ones are then joined with their places
once, and each hash's chunks are compared, line by line: one whose texts are not all the same bytes isn't repeated.

Defined results: a null text stays null and an empty one empty; chunks without a word, and texts of one line, always stay; a very long
text is chunked whole, with work in proportion to its length; a document loses its row when all its lines go; rows that agree in doc_id
and text are one document and are treated alike; of equal places the one of the smaller text hash is first; a null doc_id comes last in
the order of places; all other columns come back as they are, and the added one takes a free name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import cut, fresh, stored

#: A mix is the line's hash times a factor, modulo a prime. Each further mix finds most of the passages that the others miss.
FACTORS, PRIME = (1, 1103515245, 69069), 4294967291
#: Below it (four fifths of the range) a line is a border: chunks have two lines, or a few more.
BORDER = PRIME * 4 // 5


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(lines: Column) -> Column:
    """32 bits of each line's md5, which other engines have too."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))


def line_key(line: Column) -> Column:
    """The hash by which equal lines meet to be compared."""
    return F.xxhash64(line)


def chunk_key(lines: Column) -> Column:
    return F.xxhash64(lines)


def between(lines: Column, first: Column, last: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda k: F.get(lines, k))


def borders(mixed: Column) -> Column:
    """The first line, the last one, and those whose mix is low."""
    return F.filter(F.sequence(F.lit(0), F.size(mixed) - 1), lambda i: (i == 0) | (i == F.size(mixed) - 1) | (F.get(mixed, i) < BORDER))


def chunked(text: Column) -> Column:
    """The chunks of a text that have a word: their first and last line and a hash of their lines."""

    def chunks(lines: Column) -> Column:
        wordy = F.transform(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def of(hashes: Column, factor: int) -> Column:
            found = let(F.transform(hashes, lambda h: h * factor % PRIME), lambda mixed: let(borders(mixed), lambda b: F.transform(b, lambda first, j: F.struct(first.alias("first"), F.get(b, j + 1).alias("last")))))
            return F.filter(found, lambda c: c["last"].isNotNull())

        def hashed(found: Column) -> Column:
            return F.transform(found, lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), chunk_key(between(lines, c["first"], c["last"])).alias("hash")))

        every = let(line_hashes(lines), lambda h: F.concat(*(of(h, x) for x in FACTORS)))
        return let(wordy, lambda w: hashed(F.filter(every, lambda c: F.exists(F.sequence(c["first"], c["last"]), lambda k: F.get(w, k)))))

    return let(lines_of(text), chunks)


def repeated_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row, _marks: for each document that has some, its chunks whose hash occurs again, and whether each stands at its first place."""
    found = stored(
        docs.where(F.instr(F.col(text), "\n") > 0)
        # in two steps: what stands beside an explode is computed, and carried, for each of its rows
        .select(F.xxhash64(F.col("doc_id"), F.col(text)).alias("_row"), F.col("doc_id").alias("_doc"), chunked(F.col(text)).alias("_all"))
        .select("_row", "_doc", F.explode("_all").alias("_c"))
        # few and narrow columns, since every chunk is shuffled; a null doc_id comes last
        .select("_row", F.coalesce(F.col("_doc").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), F.shiftleft(F.col("_c.first").cast("long"), 32).bitwiseOR(F.col("_c.last").cast("long")).alias("_span"), F.col("_c.hash").alias("_hash")),
        "chunks",
        compression="zstd",
    )
    place = F.struct("_doc", "_row", "_span")
    # cut: with an exchange of its own on either side, Spark splits the join of a chunk that very many documents hold
    # several mixes may give one place the same chunk, and rows that agree are one document: what counts is another place
    groups = cut(found.groupBy("_hash").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first != _last").select(F.col("_hash").alias("_h"), "_first"))
    again = found.join(groups, F.col("_hash") == F.col("_h"))
    first, last = F.shiftright("_span", 32).cast("int"), F.col("_span").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    mark = F.struct(first.alias("first"), last.alias("last"), F.col("_hash").alias("hash"), (place == F.col("_first")).alias("stays"))
    return again.groupBy("_row").agg(F.collect_set(mark).alias("_marks"))


def ambiguous(rows: DataFrame) -> DataFrame:
    """_h: the hashes of rows (_h, content) that stand for more than one content. Each task sends a content of a hash once."""
    # cut: with an exchange of its own on either side, Spark splits the join of a hash that very many documents hold
    return cut(rows.select("_h", "content").distinct().groupBy("_h").count().where("count > 1").select("_h"))


def unlike_chunks(held: DataFrame) -> DataFrame:
    """_h: the hashes in `marks` whose chunks are not all the same bytes.

    Lines are compared byte by byte, and chunks by the hashes of their lines: so a line travels once, though several chunks hold it. Where
    two different lines share a hash, the chunks with such a line are compared by their texts.
    """
    lines = held.select(lines_of(F.col("text")).alias("lines"), "marks")
    covered = F.array_distinct(F.flatten(F.transform("marks", lambda m: F.sequence(m["first"], m["last"]))))
    twice = ambiguous(lines.select(F.explode(F.transform(covered, lambda k: F.get(F.col("lines"), k))).alias("content")).select(line_key(F.col("content")).alias("_h"), "content"))

    def sequences(keys: Column) -> Column:
        return F.transform("marks", lambda m: F.struct(m["hash"].alias("_h"), between(keys, m["first"], m["last"]).alias("content")))

    chunks = lines.select(let(F.transform("lines", line_key), sequences).alias("_all")).select(F.explode("_all").alias("_c")).select("_c.*")
    unlike = ambiguous(chunks)
    if not twice.limit(1).count():
        return unlike
    held_by = chunks.distinct().select("_h", F.explode("content").alias("_line")).join(twice.withColumnRenamed("_h", "_line"), "_line", "left_semi").select("_h").distinct()
    texts = F.transform("marks", lambda m: F.struct(m["hash"].alias("_h"), F.array_join(between(F.col("lines"), m["first"], m["last"]), "\n").alias("content")))
    return cut(unlike.union(ambiguous(lines.select(F.explode(texts).alias("_c")).select("_c.*").join(cut(held_by), "_h", "left_semi"))).distinct())


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the lines of repeated chunks removed from their texts, plus `n_removed`, the number of lines that went."""
    own, row, marks, removed, gone = (fresh(docs, c) for c in ("_own", "_row", "_marks", "n_removed", "_gone"))
    places = repeated_chunks(docs, text).toDF(row, marks)
    joined = stored(docs.withColumn(own, F.xxhash64(F.col("doc_id"), F.col(text))).join(places, F.col(own) == F.col(row), "left").drop(row), "marked", compression="zstd")

    unlike = unlike_chunks(joined.where(F.col(marks).isNotNull()).select(F.col(text).alias("text"), F.col(marks).alias("marks")))
    dropped = F.filter(F.col(marks), lambda m: ~m["stays"])
    if unlike.limit(1).count():  # two different chunks of one 64-bit hash: neither goes
        alike = joined.where(F.col(marks).isNotNull()).select(own, F.explode(marks).alias("m")).join(unlike, F.col("m.hash") == F.col("_h"), "left_anti")
        left = alike.groupBy(F.col(own).alias(row)).agg(F.collect_set("m").alias("m"))
        joined = joined.drop(marks).join(left.withColumnRenamed("m", marks), F.col(own) == F.col(row), "left").drop(row)
    lines = lambda found: F.flatten(F.transform(found, lambda m: F.sequence(m["first"], m["last"])))
    lost = F.array_except(lines(dropped), lines(F.filter(F.col(marks), lambda m: m["stays"])))
    joined = joined.withColumn(gone, F.when(F.size(lost) > 0, lost))

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))  # by hashing: in proportion to the text
        return F.when(F.size(left) > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))

    # null where nothing is left
    joined = joined.withColumn(own, F.when(F.col(gone).isNotNull(), let(lines_of(F.col(text)), without)))
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.col(own))
    return joined.where(F.col(gone).isNull() | F.col(own).isNotNull()).select(*(kept.alias(c) if c == text else F.col(c) for c in docs.columns), F.coalesce(F.size(gone), F.lit(0)).alias(removed))


SQL = r"""
WITH lines AS (
  SELECT doc_id, t.i AS i, s[t.i] AS line, f.f AS f, ('0x' || md5(s[t.i])[1:8])::BIGINT * f.f % 4294967291 AS k, len(s) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL) d, range(1, len(s) + 1) t(i), (VALUES (1), (1103515245), (69069)) f(f)),
turned AS (
  SELECT *, CASE WHEN i = 1 OR i = n OR k < 4294967291 * 4 // 5 THEN 1 ELSE 0 END AS turn FROM lines),
counted AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id, f ORDER BY i) AS upto FROM turned),
members AS (
  SELECT doc_id, f, i, line, upto - turn AS chunk_no FROM counted WHERE i > 1
  UNION ALL SELECT doc_id, f, i, line, upto FROM counted WHERE turn = 1 AND i < n),
chunks AS (SELECT doc_id, chunk_no, f, min(i) AS lo, max(i) AS hi, string_agg(line, chr(10) ORDER BY i) AS chunk FROM members GROUP BY doc_id, chunk_no, f),
worded AS (SELECT DISTINCT doc_id, lo, hi, chunk FROM chunks WHERE regexp_matches(chunk, '[^\x20\x09-\x0D]')),
judged AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, lo) > 1 AS gone, count(*) OVER (PARTITION BY chunk) > 1 AS again FROM worded),
lost AS (SELECT doc_id, t.i AS i FROM judged, range(lo, hi + 1) t(i) WHERE gone EXCEPT SELECT doc_id, t.i FROM judged, range(lo, hi + 1) t(i) WHERE again AND NOT gone),
texts AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL) AS kept, count(*) FILTER (WHERE x.i IS NULL) AS left_over, count(x.i)::INT AS n_removed
  FROM lines l LEFT JOIN lost x ON l.doc_id = x.doc_id AND l.i = x.i WHERE l.f = 1 GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN t.n_removed > 0 THEN t.kept ELSE d.text END AS text, d.lang, d.source, d.n_chars, coalesce(t.n_removed, 0)::INT AS n_removed
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id WHERE t.left_over IS NULL OR t.left_over > 0
"""
