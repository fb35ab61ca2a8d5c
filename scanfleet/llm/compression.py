"""Compressed sizes of texts against zstandard raw-content dictionaries, and bounded samples to make those from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the hash that picks samples.
HASHES = 1 << 31


class Dictionaries:
    """One compressor per class and level, made when first used, so that a worker digests each dictionary once."""

    def __init__(self, contents: list[bytes], level: int, chunk: int):
        self.contents, self.level, self.chunk = contents, level, chunk
        self._made: dict[int, list] = {}

    def __getstate__(self):
        return self.contents, self.level, self.chunk

    def __setstate__(self, state):
        self.__init__(*state)

    def compressors(self, level: int) -> list:
        if level not in self._made:
            import zstandard

            made = []
            for content in self.contents:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._made[level] = made
        return self._made[level]

    def sizes(self, data: bytes, level: int | None = None) -> list[int]:
        """Bytes that the whole of ``data`` takes with each dictionary. It is cut into chunks, each against the dictionary
        alone, so that a long text doesn't become its own dictionary."""
        parts = [data[i : i + self.chunk] for i in range(0, max(1, len(data)), self.chunk)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors(level or self.level)]


def sample(rows: DataFrame, label: str, counts: dict, per_class: int, key: Column) -> DataFrame:
    """About ``per_class`` rows of each class and never more, with distinct ``key``, as its hash picks them: first every row below a share of the hash's
    range that leaves four times as many, then the lowest of each key. No class's rows meet in one task before they are so few, and copies
    of one text are one before that. ``hash`` tells their order."""
    hashed = rows.withColumn("hash", F.xxhash64(F.lit("sample"), key))
    if not counts:
        return hashed.limit(0)
    limit = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, int(min(1.0, 4 * per_class / n) * HASHES))])
    few = hashed.where(F.pmod(F.col("hash"), F.lit(HASHES)) < limit[F.col(label)]).dropDuplicates([label, "hash"])
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("hash"))).where(F.col("_k") <= per_class).drop("_k")


def excerpt(text: Column, chars: int) -> Column:
    """At most ``chars`` characters of a text, for dictionaries: from its middle, past shared headings."""
    return F.substring(text, F.greatest(F.lit(1), F.floor((F.length(text) - chars) / 2).cast("int") + 1), F.lit(chars))


def dictionary(texts: list[str], size: int) -> bytes:
    """Something of each distinct text, ``size`` bytes at most: where they don't fit, the middles of the longer ones, all cut to one length."""
    parts = [t.encode() for t in dict.fromkeys(texts)]
    room, left = size - len(parts), sorted(map(len, parts))
    cut = 0
    for i, n in enumerate(left):  # short ones leave more to the others
        cut = max(0, room) // (len(left) - i)
        if n > cut:
            break
        room, cut = room - n, n
    middle = lambda p: p if len(p) <= cut else p[(len(p) - cut) // 2 :][:cut].decode(errors="ignore").encode()
    return b"\n".join(map(middle, parts))[:size]
