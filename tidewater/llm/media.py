"""Copies of images by local descriptors: multiscale corners, orientation-normalised binary tests, Hamming tables, consensus.

1. Corners of a structure tensor at several scales get an orientation from their intensity centroid and 128 binary tests on the
   patch turned to it. Identical images collapse to one first.
2. Hamming tables: 128 bits are four keys of 32, so descriptors that differ in at most three bits share a key. Descriptors that
   share one are compared in full, as most meet by chance; images with a match are put in one block, whose size is bounded by
   pairs of chunks.
3. In a block, descriptors are looked up in the four tables; two images are linked if enough matches agree on one shift,
   rotation and scale. Links become components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.similarity import components
from tidewater.llm.text import table
from tidewater.spark import materialize, ship, split_join

#: Scales, each half the one before; corners kept at each; tests of a descriptor; radius of its patch.
SCALES, CORNERS, BITS, RADIUS = 3, 24, 128, 9
#: Bits that matching descriptors may differ in, and agreeing matches that link two images.
FAR_BITS, CONSENSUS = 3, 5
#: Descriptors of a block that one task holds.
BLOCK_DESCRIPTORS = 120_000

_rng = np.random.default_rng(20)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS + 1, RADIUS - 1)
_GRID = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1), indexing="ij"), axis=-1)
_DISC = (_GRID**2).sum(axis=-1) <= RADIUS**2


def _blur(x: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(x, 1, mode="edge")
        p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
        x = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
    return x


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of a grey image, as rows (y, x, angle, scale) in its own pixels, and their descriptors (four unsigned 32-bit
    keys). Images too small for a patch have none."""
    at, keys, image, scale = [], [], pixels.astype(float), 1.0
    for _ in range(SCALES):
        if min(image.shape) <= 2 * RADIUS + 2:
            break
        smooth = _blur(image, 2)
        gy, gx = np.gradient(smooth)
        a, b, c = _blur(gy * gy, 2), _blur(gx * gx, 2), _blur(gy * gx, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        p = np.pad(strength, 1, constant_values=-np.inf)
        top = np.max([p[i : i + strength.shape[0], j : j + strength.shape[1]] for i in range(3) for j in range(3)], axis=0)
        m = RADIUS + 1
        inner = np.zeros(strength.shape, dtype=bool)
        inner[m:-m, m:-m] = True
        y, x = np.nonzero((strength >= top) & inner & (strength > 1e-3))
        best = np.lexsort((x, y, -np.round(strength[y, x], 6)))[:CORNERS]
        y, x = y[best], x[best]
        if len(y):
            patch = smooth[y[:, None, None] + _GRID[..., 0], x[:, None, None] + _GRID[..., 1]] * _DISC
            angle = np.arctan2((patch * _GRID[..., 0]).sum(axis=(1, 2)), (patch * _GRID[..., 1]).sum(axis=(1, 2)))
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            value = []
            for dy, dx in ((_TESTS[:, 0], _TESTS[:, 1]), (_TESTS[:, 2], _TESTS[:, 3])):
                ry, rx = np.rint(cos * dy + sin * dx).astype(int), np.rint(cos * dx - sin * dy).astype(int)
                value.append(smooth[y[:, None] + np.clip(ry, -m, m), x[:, None] + np.clip(rx, -m, m)])
            bits = value[0] < value[1]
            keys.append(np.packbits(bits, axis=1).view(">u4").astype(np.uint32))
            at.append(np.column_stack([y * scale + (scale - 1) / 2, x * scale + (scale - 1) / 2, angle, np.full(len(y), scale)]))
        h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
        image = (image[:h:2, :w:2] + image[1:h:2, :w:2] + image[:h:2, 1:w:2] + image[1:h:2, 1:w:2]) / 4
        scale *= 2
    return (np.concatenate(at), np.concatenate(keys)) if at else (np.zeros((0, 4)), np.zeros((0, 4), dtype=np.uint32))


def agreeing(p: np.ndarray, q: np.ndarray) -> int:
    """How many matched corners of two images agree on one similarity transform: each match is tried as the transform."""
    turn, grow = q[:, 2] - p[:, 2], q[:, 3] / p[:, 3]
    c, s = np.cos(turn) * grow, np.sin(turn) * grow
    ty, tx = q[:, 0] - (c * p[:, 0] + s * p[:, 1]), q[:, 1] - (c * p[:, 1] - s * p[:, 0])
    py = c[:, None] * p[:, 0] + s[:, None] * p[:, 1] + ty[:, None]
    px = c[:, None] * p[:, 1] - s[:, None] * p[:, 0] + tx[:, None]
    near = np.hypot(py - q[:, 0], px - q[:, 1]) <= 3 * q[:, 3]
    # corners of one place count once
    return max((len({(round(a / 2), round(b / 2)) for a, b in p[n, :2]}) for n in near), default=0)


class Gallery:
    """The images of one block, with the four Hamming tables of their descriptors."""

    def __init__(self, corners: list[np.ndarray], keys: list[np.ndarray]):
        self.corners, self.start = corners, np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        self.keys, self.image = np.concatenate(keys), np.repeat(np.arange(len(keys)), np.diff(self.start))
        self.flat = np.concatenate(corners)
        self.order = [np.argsort(self.keys[:, t], kind="stable") for t in range(4)]
        self.sorted = [self.keys[o, t] for t, o in enumerate(self.order)]

    def search(self, i: int, skip: np.ndarray) -> list[int]:
        """Images linked with image ``i`` among those that ``skip`` doesn't mark."""
        mine = np.arange(self.start[i], self.start[i + 1])
        pairs = []
        for t in range(4):
            low = np.searchsorted(self.sorted[t], self.keys[mine, t], side="left")
            n = np.searchsorted(self.sorted[t], self.keys[mine, t], side="right") - low
            other = self.order[t][np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            pairs.append(np.column_stack([np.repeat(mine, n), other]))
        pair = np.concatenate(pairs)
        pair = np.unique(pair[~skip[self.image[pair[:, 1]]] & (self.image[pair[:, 1]] != i)], axis=0)
        if not len(pair):
            return []
        far = np.bitwise_count(self.keys[pair[:, 0]] ^ self.keys[pair[:, 1]]).sum(axis=1)
        pair = pair[far <= FAR_BITS]
        image = self.image[pair[:, 1]]
        order = np.argsort(image, kind="stable")
        pair, image = pair[order], image[order]
        edge = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1], [True]])) if len(image) else np.zeros(1, int)
        return [int(image[a]) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a >= CONSENSUS and agreeing(self.flat[pair[a:b, 0]], self.flat[pair[a:b, 1]]) >= CONSENSUS]

    def forest(self) -> np.ndarray:
        """The component of each image in the block. An image is searched unless a searched one has reached it; then only links
        between images reached in different components are unknown, and one end of each lies outside the largest one."""
        label = np.arange(len(self.corners))
        searched, reached = np.zeros((2, len(label)), dtype=bool)

        def run(i: int) -> None:
            searched[i] = True
            for j in self.search(i, label == label[i]):
                reached[j] = True
                label[label == max(label[i], label[j])] = min(label[i], label[j])

        for i in range(len(label)):
            if not reached[i]:
                run(i)
        if not searched.all():
            largest = np.bincount(label[~searched]).argmax()
            for i in np.flatnonzero(~searched & (label != largest)):
                run(int(i))
        return label


#: Up to so many descriptors of one key are compared pair by pair; more are joined one after the other.
FEW = 16


def meeting(key: np.ndarray, image: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows (a, b) of images that connect all images with descriptors of one key at most FAR_BITS apart. ``key`` is sorted and holds
    whole runs; ``bits`` has two 64-bit halves a row. Of a long run each image is given with the first one it connects to only."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    size = np.diff(edge)
    rest = np.repeat(edge[1:], size) - np.arange(len(key)) - 1
    rest[np.repeat(size > FEW, size)] = 0
    left = np.repeat(np.arange(len(key)), rest)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest)
    near = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1) <= FAR_BITS
    out = [np.column_stack([image[left[near]], image[right[near]]])]
    for k in np.flatnonzero(size > FEW):
        run = slice(edge[k], edge[k + 1])
        each, row = np.unique(bits[run], axis=0, return_inverse=True)
        label, free = np.full(len(each), -1), np.arange(len(each))
        while len(free):
            todo, now, free = [free[0]], free[0], free[1:]
            label[now] = now
            while todo and len(free):
                close = np.bitwise_count(each[free] ^ each[todo.pop()]).sum(axis=1) <= FAR_BITS
                label[free[close]] = now
                todo += free[close].tolist()
                free = free[~close]
        group = label[row.ravel()]
        order = np.lexsort((image[run], group))
        group, member = group[order], image[run][order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        out.append(np.column_stack([member, member[first][np.cumsum(first) - 1]]))
    pairs = np.concatenate(out)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def link_images(images: DataFrame, block: int | None = None) -> DataFrame:
    """One row for each row of ``images`` (image_id, pixels, height, width; grey, one byte a pixel, row by row): image_id,
    n_corners, class_id, the smallest image_id reachable by links, itself included.

    Images that are null, have no size or not height x width bytes have no corners and no links; those with identical pixels are
    linked, and so are rows of one image_id, whatever their pixels: none of them is lost. Rows of a null image_id take no part and get
    a null class. Any size is read whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    ship(images.sparkSession)
    block = block or BLOCK_DESCRIPTORS
    rows = images.select(F.col("image_id").cast("long"), F.col("pixels"), F.col("height").cast("int"), F.col("width").cast("int"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, raw, h, w in zip(pdf.image_id, pdf.pixels, pdf.height, pdf.width, strict=True):
                good = raw is not None and h == h and w == w and h > 0 and w > 0 and len(raw) == int(h) * int(w)
                corners, keys = describe(np.frombuffer(raw, np.uint8).reshape(int(h), int(w))) if good else (np.zeros((0, 4)), np.zeros((0, 4), np.uint32))
                digest = hashlib.md5(raw + f":{int(h)}".encode()).hexdigest() if good else None
                out.append((i, digest, len(keys), corners.astype("<f4").tobytes(), keys.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "digest", "n", "corners", "descriptors"]).astype({"image_id": "Int64"})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                keys = np.frombuffer(b"".join(pdf.descriptors), "<u4").reshape(-1, 4)
                image, bits = np.repeat(pdf.image_id.to_numpy("int64"), pdf.n), np.ascontiguousarray(keys).view("<i8")
                for t in range(4):
                    yield pd.DataFrame({"key": keys[:, t].astype("int64") | t << 32, "image_id": image, "low": bits[:, 0], "high": bits[:, 1]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []

        def close(rows: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(rows)
            return pd.DataFrame(meeting(pdf.key.to_numpy(), pdf.image_id.to_numpy(), pdf[["low", "high"]].to_numpy("int64").view("uint64")), columns=["a", "b"], dtype="int64")

        # the last run of a batch may go on in the next one
        for pdf in batches:
            if not len(pdf):
                continue
            last = int(np.searchsorted(pdf.key.to_numpy(), pdf.key.iloc[-1]))
            if last or held and held[-1].key.iloc[-1] != pdf.key.iloc[0]:
                yield close([*held, pdf[:last]])
                held = []
            held.append(pdf[last:])
        if held:
            yield close(held)

    schema = "image_id long, digest string, n int, corners binary, descriptors binary"
    # pixels of identical images are described once
    named = rows.filter("image_id is not null").withColumn("_same", F.md5(F.concat("pixels", F.encode(F.concat(F.lit(":"), F.coalesce("height", F.lit(0)), F.lit(":"), F.coalesce("width", F.lit(0))), "utf-8"))))
    # a content goes by its least id; if that is another content's too, by a number of its own below all ids that are likely
    own = F.row_number().over(Window.partitionBy("rep").orderBy("_same"))
    number = -F.conv(F.substring("_same", 1, 15), 16, 10).cast("long") - 1
    firsts = materialize(named.filter("_same is not null").groupBy("_same").agg(F.min("image_id").alias("rep")).withColumn("_k", own).withColumn("name", F.when(F.col("_k") == 1, F.col("rep")).otherwise(number)).drop("_k"))
    ids = materialize(named.select("image_id", "_same").join(firsts, "_same", "left").select("image_id", F.coalesce("name", "image_id").alias("name"), F.when(F.col("_same").isNotNull(), F.coalesce("name", "image_id")).alias("content")))
    alone = named.join(firsts, (F.col("image_id") == F.col("rep")) & (named["_same"] == firsts["_same"])).dropDuplicates(["name"])
    made = materialize(alone.select(F.col("name").alias("image_id"), "pixels", "height", "width").mapInPandas(extract, schema))
    keyed = made.select("image_id", "n", "descriptors").mapInPandas(spread, "key long, image_id long, low long, high long")
    blocks = components(keyed.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "a long, b long").distinct())
    total = made.join(blocks, F.col("image_id") == F.col("node")).groupBy("component").agg(F.sum("n").alias("total"))
    total = total.select(F.col("component").alias("_c"), F.when(F.col("total") <= block, 1).otherwise(F.ceil(F.col("total") * 2 / block)).cast("int").alias("chunks"))
    members = made.join(blocks, F.col("image_id") == F.col("node")).join(total, F.col("component") == F.col("_c"))
    mine = F.pmod(F.xxhash64("image_id"), F.col("chunks")).cast("int")
    dealt = members.withColumn("_m", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.concat_ws(":", "component", F.least("_m", "_o"), F.greatest("_m", "_o")).alias("block"), "image_id", "corners", "descriptors")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, links = None, [], []

        def close() -> None:
            if len(held) > 1:
                gallery = Gallery([np.frombuffer(c, "<f4").reshape(-1, 4).astype(float) for _, c, _ in held], [np.frombuffer(d, "<u4").reshape(-1, 4) for *_, d in held])
                links.extend((held[i][0], held[j][0]) for i, j in enumerate(gallery.forest()) if i != j)

        for pdf in batches:
            for name, i, c, d in zip(pdf.block, pdf.image_id, pdf.corners, pdf.descriptors, strict=True):
                if name != now:
                    close()
                    now, held = name, []
                held.append((i, c, d))
        close()
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    # rows of one id are one class, whatever their pixels
    several = ids.groupBy("image_id").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a != b")
    same_id = ids.join(several.select("image_id", "a"), "image_id").filter("a != name").select("a", F.col("name").alias("b")).distinct()
    links = dealt.repartition("block").sortWithinPartitions("block", "image_id").mapInPandas(search, "a long, b long")
    found = components(links.unionByName(same_id))
    out = ids.join(made.select(F.col("image_id").alias("_i"), "n"), F.col("content") == F.col("_i"), "left").join(found, F.col("name") == F.col("node"), "left")
    out = out.select("image_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_corners"), F.coalesce("component", "name").alias("component"))
    least = out.groupBy("component").agg(F.min("image_id").alias("class_id"))
    out = split_join(out, least, ["component"]).select("image_id", "n_corners", "class_id")
    return out.unionByName(rows.filter("image_id is null").select("image_id", F.lit(0).cast("long").alias("n_corners"), F.lit(None).cast("long").alias("class_id")))


#: Pixels a side of a component's cell, and the patterns that components add: noise under a window of three cells a side.
CELL = 8
_WINDOW = np.hanning(3 * CELL + 2)[1:-1]
_PATTERNS = np.stack([_blur(x) for x in np.random.default_rng(21).normal(size=(1024, 3 * CELL, 3 * CELL))]) * np.outer(_WINDOW, _WINDOW)
#: Grey values of an image spread by about GREY round the middle.
GREY = 40.0
_PATTERNS *= GREY / np.sqrt(np.square(_PATTERNS).sum(axis=(1, 2)).mean() / CELL**2)


def draw(vector: np.ndarray) -> np.ndarray:
    """A grey image that is linear in the components but for their common scale and rounding: each adds its pattern, as strong as it
    is, round its cell of a square grid. Small changes of a vector are small changes everywhere, a few changed components are edits
    of a few places, and a vector times a positive number gives the same image."""
    n = int(np.ceil(np.sqrt(len(vector))))
    v = np.resize(vector, n * n)
    v = v / max(np.abs(v).max(), 1e-300)
    v /= max(np.sqrt(np.square(v).mean()), 1e-300)
    add = (v[:, None, None] * _PATTERNS[np.arange(n * n) % len(_PATTERNS)]).reshape(n, n, 3, CELL, 3, CELL)
    whole = np.zeros((n + 2, CELL, n + 2, CELL))
    for i in range(3):
        for j in range(3):
            whole[i : i + n, :, j : j + n] += add[:, :, i, :, j].transpose(0, 2, 1, 3)
    return np.rint(np.clip(whole[1:-1, :, 1:-1] + 128, 0, 255)).astype(np.uint8).reshape(CELL * n, CELL * n)


def drawn(vectors: DataFrame) -> DataFrame:
    """The image of each vector (``draw``). The driver's tables hold no images; this is what the query below runs on. Null, empty
    or non-finite vectors have no image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, e in zip(pdf.vec_id, pdf.embedding, strict=True):
                v = None if e is None else np.array(e, dtype=float)
                if v is None or not len(v) or not np.isfinite(v).all():
                    out.append((i, None, 0, 0))
                    continue
                whole = draw(v)
                out.append((i, whole.tobytes(), *whole.shape))
            yield pd.DataFrame(out, columns=["image_id", "pixels", "height", "width"]).astype({"image_id": "Int64"})

    ship(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInPandas(run, "image_id long, pixels binary, height int, width int")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among images drawn from all ``embeddings``."""
    return link_images(drawn(table(spark, sf_dir, "embeddings"))).withColumnRenamed("image_id", "vec_id")
