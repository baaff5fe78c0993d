"""Boxes on pages.

Boxes are columns x, y, width, height with an image id. What is order-dependent (greedy suppression, recursive
cuts, rectangle merging) runs per image in grouped pandas; an image's boxes are few by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import contained, greatest, iou, least

BOX = ("x", "y", "width", "height")
# The eleven layout classes by id, and the macro regions as shares of the page.
LABELS = ("Caption", "Footnote", "Formula", "List-item", "Page-footer", "Page-header", "Picture", "Section-header", "Table", "Text", "Title")
MACRO_REGIONS = (("header", "Header", 0, 0, 1, 0.15), ("address", "Address", 0, 0.12, 0.55, 0.38), ("meta", "Meta", 0.55, 0.12, 1, 0.38), ("body", "Body", 0, 0.32, 1, 0.88), ("footer", "Footer", 0, 0.85, 1, 1))
# Weights of macro regions.
REGION_WEIGHTS = {"Body": 0.4, "Address": 0.2, "Meta": 0.15, "Header": 0.15, "Footer": 0.1}
OTHER_WEIGHT = 0.1
# The most intersection over union and the containment at which suppression keeps one of two boxes.
SUPPRESSION = (0.6, 0.3)


def region_weight(label: Column) -> Column:
    """P24."""
    out = F.lit(OTHER_WEIGHT)
    for name, w in REGION_WEIGHTS.items():
        out = F.when(label == name, w).otherwise(out)
    return out


def macro_regions(pages: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """P25: five boxes a page, in whole pixels of at least one."""
    w, h = F.col(width), F.col(height)
    at = lambda share, size: F.floor(F.lit(float(share)) * size + 0.5)
    boxes = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("region"), F.lit(label).alias("label"), at(x0, w).alias("x"), at(y0, h).alias("y"), F.greatest(F.lit(1), at(x1, w) - at(x0, w)).alias("box_width"), F.greatest(F.lit(1), at(y1, h) - at(y0, h)).alias("box_height"))
        for i, (name, label, x0, y0, x1, y1) in enumerate(MACRO_REGIONS)
    ]
    return pages.select("*", F.inline(F.array(*boxes)))


def sanitised(xmin: Column, ymin: Column, xmax: Column, ymax: Column, sx: Column, sy: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A detection in image pixels, two pixels off the edges and at least five wide and high."""
    x = F.floor(greatest(F.lit(2.0), least(width - 10, xmin * sx)))
    y = F.floor(greatest(F.lit(2.0), least(height - 10, ymin * sy)))
    w = F.ceil(greatest(F.lit(5.0), least(width - x - 2, (xmax - xmin) * sx)))
    h = F.ceil(greatest(F.lit(5.0), least(height - y - 2, (ymax - ymin) * sy)))
    return x, y, w, h


def cropped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """The part of a box that lies on the image, of at least one pixel."""
    left, top = greatest(F.lit(0), F.floor(x)), greatest(F.lit(0), F.floor(y))
    return left, top, greatest(F.lit(1), least(F.floor(w), width - left)), greatest(F.lit(1), least(F.floor(h), height - top))


# Pixels that a safe crop keeps off the edges, and its least size.
SAFE_EDGE, SAFE_LEAST = 2, 10


def safely_cropped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, padding: float = 0) -> tuple[Column, Column, Column, Column]:
    """A padded box SAFE_EDGE pixels off the image's edges and SAFE_LEAST pixels wide and high, or what the image leaves."""
    edge, small = F.lit(SAFE_EDGE), F.lit(SAFE_LEAST)
    left = F.floor(greatest(edge, least(width - SAFE_LEAST - SAFE_EDGE, x - padding)))
    top = F.floor(greatest(edge, least(height - SAFE_LEAST - SAFE_EDGE, y - padding)))
    return left, top, F.ceil(least(width - left - SAFE_EDGE, greatest(small, w + 2 * padding))), F.ceil(least(height - top - SAFE_EDGE, greatest(small, h + 2 * padding)))


def table_cropped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, padding: float = 0) -> tuple[Column, Column, Column, Column]:
    """A padded box cut at the image's edges."""
    left, top = greatest(F.lit(0), F.floor(x - padding)), greatest(F.lit(0), F.floor(y - padding))
    return left, top, least(width - left, F.ceil(w + 2 * padding)), least(height - top, F.ceil(h + 2 * padding))


# The classes whose regions are read as text.
TEXT_LABELS = ("Text", "Title", "Section-header", "Caption", "List-item", "Page-header", "Page-footer", "Footnote", "Table")


def detections(rows: DataFrame, least_score: float, width: Column, height: Column) -> DataFrame:
    """Detections (xmin, ymin, xmax, ymax as shares of the image, score, id) of known classes and enough score, as boxes with a label."""
    at = F.floor(F.col("id") + 0.5).cast("int")
    label = F.get(F.array(*map(F.lit, LABELS)), at)
    x, y, w, h = sanitised(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), width, height, width, height)
    known = rows.withColumn("label", label).where((F.col("score") >= least_score) & F.col("label").isNotNull())
    return known.withColumns({"x": x, "y": y, "width": w, "height": h}).drop("xmin", "ymin", "xmax", "ymax", "id")


def text_regions(regions: DataFrame, labels: tuple[str, ...] = TEXT_LABELS) -> DataFrame:
    """P5: regions that are read as text."""
    return regions.where(F.col("label").isin(*labels))


def table_regions(regions: DataFrame) -> DataFrame:
    """P5."""
    return regions.where(F.col("label") == "Table")


def hull(boxes: DataFrame, by: list[str]) -> DataFrame:
    """A18."""
    return boxes.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))


def overlapping_pairs(boxes: DataFrame, by: str, box_id: str, least: float) -> DataFrame:
    """Pairs of one image with an intersection over union above ``least``."""
    a, b = (boxes.select(F.col(by), F.col(box_id).alias(f"{box_id}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in BOX]) for s in "ab")
    value = iou(*[F.col(f"{c}_a") for c in BOX], *[F.col(f"{c}_b") for c in BOX])
    return a.join(b, by).where(F.col(f"{box_id}_a") < F.col(f"{box_id}_b")).withColumn("iou", value).where(F.col("iou") > least).select(by, f"{box_id}_a", f"{box_id}_b", "iou")


def _area(a: tuple, b: tuple) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return max(w, 0.0) * max(h, 0.0)


def suppressed(boxes: list[tuple], scores: list[float], most_iou: float, containment: float) -> list[int]:
    """Positions kept by greedy suppression, best score first. A box goes if it overlaps a kept
    one by more than ``most_iou``, or if either holds ``containment`` or more of the other."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda k: (-scores[k], k)):
        mine = boxes[i][2] * boxes[i][3]
        for j in kept:
            both, other = _area(boxes[i], boxes[j]), boxes[j][2] * boxes[j][3]
            union = mine + other - both
            if (union > 0 and both / union > most_iou) or (mine > 0 and both / mine >= containment) or (other > 0 and both / other >= containment):
                break
        else:
            kept.append(i)
    return kept


def per_image(rows: DataFrame, by: str, order: list[str], apply: Callable[[list[tuple]], list[tuple]], kinds: str) -> DataFrame:
    """``apply`` to the ordered rows of each image, as tuples of what follows ``by``; its tuples get ``by`` in front.
    Images stream through Arrow batches one after the other, so a call costs no more than its rows."""
    kind = dict(rows.dtypes)[by]
    schema = f"{by} {kind}, {kinds}"
    names = [k.split()[0] for k in schema.split(", ")]
    # Only one image's rows are held at a time.
    types = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    arrow = pa.schema([(k.split()[0], types[k.split()[1]]) for k in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        for key, own in groupby(stream(), key=lambda r: r[0]):
            out += [(key, *r) for r in apply([r[1:] for r in own])]
            if len(out) >= 10_000:
                yield pa.record_batch([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(zip(*out, strict=True))], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(zip(*out, strict=True))], names=names)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def non_maximum_suppression(boxes: DataFrame, by: str, box_id: str, most_iou: float = 0.5, containment: float = 0.9) -> DataFrame:
    def run(own: list[tuple]) -> list[tuple]:
        keep = suppressed([r[1:5] for r in own], [r[5] for r in own], most_iou, containment)
        return [(own[i][0], k) for k, i in enumerate(keep, 1)]

    return per_image(boxes.select(by, box_id, *BOX, "score"), by, [box_id, *BOX, "score"], run, f"{box_id} {dict(boxes.dtypes)[box_id]}, place int")


def _widest(spans: list[tuple[float, float]], origin: float | None) -> tuple[float, float] | None:
    """(gap, middle) of the widest stretch that no span covers, the first of equal ones."""
    best, reached = None, origin
    for a, b in sorted(spans):
        if reached is not None and a > reached and (best is None or a - reached > best[0]):
            best = (a - reached, (a + reached) / 2)
        reached = b if reached is None else max(reached, b)
    return best


def reading_order(boxes: list[tuple], span_share: float = 0.7, page_width: float | None = None, least_gap: float = 30.0, depth: int = 14, origin: str = "zero") -> list[int]:
    """Positions in reading order by recursive cuts at the widest gap of ``least_gap`` or more (rows first on ties). Boxes
    nearly as wide as the page are set aside and put back before the first box that starts below them. What can't be cut
    is in the order of its upper edges, equal ones as given."""
    if not boxes:
        return []
    width = page_width or max(b[0] + b[2] for b in boxes)
    masked = sorted((i for i, b in enumerate(boxes) if b[2] >= span_share * width), key=lambda i: (boxes[i][1], i))
    free = [i for i in range(len(boxes)) if i not in set(masked)]

    def by_place(own: list[int]) -> list[int]:
        return sorted(own, key=lambda i: (boxes[i][1], i))

    def cut(own: list[int], level: int) -> list[int]:
        if len(own) < 2 or level >= depth:
            return by_place(own)
        found = []
        for axis in (1, 0):
            start = 0.0 if origin == "zero" else None
            gap = _widest([(boxes[i][axis], boxes[i][axis] + boxes[i][axis + 2]) for i in own], start)
            if gap and gap[0] >= least_gap:
                found.append((gap[0], axis, gap[1]))
        if not found:
            return by_place(own)
        _, axis, at = max(found, key=lambda f: (f[0], f[1]))
        first = [i for i in own if boxes[i][axis] + boxes[i][axis + 2] / 2 < at]
        second = [i for i in own if i not in set(first)]
        return by_place(own) if not first or not second else cut(first, level + 1) + cut(second, level + 1)

    out: list[int] = []
    waiting = list(masked)
    for i in cut(free, 0):
        while waiting and boxes[waiting[0]][1] + boxes[waiting[0]][3] <= boxes[i][1] + 0.3 * boxes[i][3]:
            out.append(waiting.pop(0))
        out.append(i)
    return out + waiting


def ordered(boxes: DataFrame, by: str, box_id: str, **options: object) -> DataFrame:
    """Reading order of each image's boxes; ``order='y'`` sorts by the upper edge instead."""
    plain = options.pop("order", "xycut") == "y"

    def run(own: list[tuple]) -> list[tuple]:
        places = range(len(own)) if plain else reading_order([r[1:5] for r in own], **options)
        return [(own[i][0], k) for k, i in enumerate(places, 1)]

    return per_image(boxes.select(by, box_id, *BOX), by, ["y", box_id, *BOX] if plain else [box_id, *BOX], run, f"{box_id} {dict(boxes.dtypes)[box_id]}, place int")


#: Grid columns that one long holds.
WORD = 62


def cover_masks(boxes: DataFrame, by: str, cell: int, columns: int, rows: int) -> DataFrame:
    """Each image's grid as ``masks``, WORD columns a long, row by row; a bit is set where a box touches the cell. One row an
    image is shuffled, however many boxes and cells there are."""
    words = -(-columns // WORD)
    on = (F.col("x") + F.col("width") > 0) & (F.col("y") + F.col("height") > 0) & (F.col("x") < columns * cell) & (F.col("y") < rows * cell) & (F.col("width") > 0) & (F.col("height") > 0)
    bound = lambda at, most: F.least(F.greatest(at, F.lit(0)), F.lit(most)).cast("int")
    spans = boxes.withColumn("_on", F.coalesce(on, F.lit(False))).select(
        by, *[F.when(F.col("_on"), v).otherwise(0).alias(n) for n, v in (("_r0", bound(F.floor(F.col("y") / cell), rows)), ("_r1", bound(F.ceil((F.col("y") + F.col("height")) / cell), rows)), ("_c0", bound(F.floor(F.col("x") / cell), columns)), ("_c1", bound(F.ceil((F.col("x") + F.col("width")) / cell), columns)))]
    )
    upto = lambda c, w: F.expr(f"shiftleft(1L, least(greatest({c} - {w * WORD}, 0), {WORD})) - 1L")
    spans = spans.select("*", *[upto("_c1", w).bitwiseXOR(upto("_c0", w)).alias(f"_m{w}") for w in range(words)])
    masks = [F.coalesce(F.bit_or(F.when((F.col("_r0") <= r) & (F.col("_r1") > r), F.col(f"_m{w}"))), F.lit(0).cast("long")).alias(f"_{r}_{w}") for r in range(rows) for w in range(words)]
    return spans.groupBy(by).agg(*masks).select(by, F.array(*[f"_{r}_{w}" for r in range(rows) for w in range(words)]).alias("masks"))


def uncovered_cells(boxes: DataFrame, by: str, cell: int, columns: int, rows: int) -> DataFrame:
    """The other cells of every image's grid."""
    words = -(-columns // WORD)
    cells = cover_masks(boxes, by, cell, columns, rows).select(by, "masks", F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1))).alias("_cell"))
    cells = cells.select(by, "masks", F.floor(F.col("_cell") / columns).cast("int").alias("row"), (F.col("_cell") % columns).alias("col"))
    mask = F.get("masks", F.col("row") * words + F.floor(F.col("col") / WORD).cast("int"))
    return cells.where(F.getbit(mask, F.col("col") % WORD) == 0).select(by, "row", "col")


def rectangles(cells: set[tuple[int, int]], columns: int, rows: int) -> list[tuple[int, int, int, int]]:
    """Free cells merged to (row, col, rows, cols), greedily to the right and then down."""
    free, out = set(cells), []
    for r in range(rows):
        for c in range(columns):
            if (r, c) not in free:
                continue
            right = c
            while (r, right + 1) in free:
                right += 1
            down = r
            while all((down + 1, k) in free for k in range(c, right + 1)):
                down += 1
            free -= {(i, k) for i in range(r, down + 1) for k in range(c, right + 1)}
            out.append((r, c, down - r + 1, right - c + 1))
    return out


def uncovered_areas(boxes: DataFrame, by: str, cell: int, width: int, height: int, least_share: float = 0.0) -> DataFrame:
    """Rectangles that no box touches, of at least a share of the page."""
    columns, rows = -(-width // cell), -(-height // cell)
    words = -(-columns // WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                free = {(r, c) for r in range(rows) for c in range(columns) if not masks[r * words + c // WORD] >> (c % WORD) & 1}
                found = [(c * cell, r * cell, min(n * cell, width - c * cell), min(m * cell, height - r * cell)) for r, c, m, n in rectangles(free, columns, rows)]
                out += [(key, *f) for f in found if f[2] * f[3] >= least_share * width * height]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4]
            yield pa.record_batch([pa.array([x[k] for x in out], type=t) for k, t in enumerate(kinds)], names=[by, "x", "y", "width", "height"])

    return cover_masks(boxes, by, cell, columns, rows).mapInArrow(run, f"{by} {dict(boxes.dtypes)[by]}, x long, y long, width long, height long")


def contains_most(a: str, b: str, share: float) -> Column:
    """M4: whether box ``a`` (a struct) holds at least ``share`` of box ``b``."""
    return contained(*[F.col(f"{a}.{c}") for c in BOX], *[F.col(f"{b}.{c}") for c in BOX]) >= share
