"""Scalar rules on names, flags, geometry and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image file extensions, format keywords and directory suffixes, in order.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
FORMAT_KEYWORDS = (("emps", "emps"), ("nist", "nist"), ("nnpipe", "nnp"), ("tio2", "tio2"))
DIRECTORY_SUFFIXES = (("_sem", "SEM"), ("_tem", "TEM"), ("_tsem", "TSEM"), ("_optical", "optical"))
LARGE_SIDE = 1536


def first_of(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out: Column | None = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def or_default(value: Column, default: str = "unknown") -> Column:
    """Null and blank become the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def flag(value: Column) -> Column:
    """true, false, blank, or the lower-case text of what is neither."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin("1", "true", "yes", "y"), "true").when(text.isin("0", "false", "no", "n"), "false").otherwise(text)


def without_tile(name: Column) -> Column:
    """A file name without the _tile_row_column that tiling puts before its extension."""
    return F.regexp_replace(name, r"_tile_\d+_\d+(?=\.[^.]+$|$)", "")


def microscope_of_file(name: Column) -> Column:
    n = without_tile(F.lower(name))
    return first_of(
        [
            (n.startswith("tio2_tsem_"), "TSEM"),
            (n.contains("emps") | n.startswith("nist_") | n.startswith("tio2_sem_"), "SEM"),
            (n.contains("cryo"), "CryoEM"),
            (n.contains("nnp") | n.contains("tem"), "TEM"),
        ],
        "unknown",
    )


def microscope_of_collection(name: Column) -> Column:
    """The older rule, in which NIST is a class of its own and numbered collections count."""
    n = F.lower(name)
    return first_of(
        [
            (n.startswith("nist_"), "NIST"),
            (n.contains("emps") | n.startswith("01_") | n.startswith("tio2_sem_"), "SEM"),
            (n.startswith("tio2_tsem_"), "TSEM"),
            (n.contains("cryo") | n.startswith("03_"), "CryoEM"),
            (n.contains("nnp") | n.startswith("04_"), "TEM"),
        ],
        "Other",
    )


def microscope_of_directory(name: Column) -> Column:
    return first_of([(F.lower(name).endswith(s), v) for s, v in DIRECTORY_SUFFIXES], "unknown")


def format_of_directory(name: Column) -> Column:
    return first_of([(F.lower(name).contains(k), v) for k, v in FORMAT_KEYWORDS], "generic")


def split_group(name: Column) -> Column:
    """What a split keeps together: a NIST set, else the file itself."""
    number = F.regexp_extract(F.lower(name), r"^nist_set(\d+)_", 1)
    return F.when(number != "", F.concat(F.lit("nist_set"), number)).otherwise(name)


def noise_contrast_kept(stem: Column, most_noise: int = 34, contrast_above: int = 6) -> Column:
    """Whether a stem's last two numbers, noise and contrast, are in range; a malformed one isn't."""
    parts = F.split(stem, "_")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    return F.coalesce((number(-2) <= most_noise) & (number(-1) > contrast_above), F.lit(False))


def is_large(height: Column, width: Column, limit: int = LARGE_SIDE) -> Column:
    return F.greatest(height, width) > limit


def source_unit(*candidates: Column) -> Column:
    """What a split must not separate: the first candidate that isn't blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def stem(path: Column) -> Column:
    """The file name without directories and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def relative_path(path: Column, base: str) -> Column:
    """The path below base with forward slashes; others stay."""
    slashes = F.translate(path, "\\", "/")
    root = base.rstrip("/") + "/"
    return F.when(slashes.startswith(root), F.substring(slashes, len(root) + 1, 1 << 30)).otherwise(slashes)


def equivalent_diameter(area: Column) -> Column:
    return F.when(area > 0, F.sqrt(4.0 * area / F.pi())).otherwise(0.0)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))


def circularity(area: Column, perimeter: Column) -> Column:
    return 4.0 * F.pi() * area / F.greatest(perimeter * perimeter, F.lit(1e-8))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, edge: float = 1e-7) -> Column:
    clamped = F.greatest(F.lit(edge), F.least(p, F.lit(1 - edge)))
    return F.log(clamped / (1 - clamped))


def clamp(x: Column, low: object, high: object) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def precision_recall_f1(matched: Column, n_pred: Column, n_gt: Column) -> tuple[Column, Column, Column]:
    p, r = matched / F.greatest(n_pred, F.lit(1)), matched / F.greatest(n_gt, F.lit(1))
    return p, r, 2 * p * r / F.greatest(p + r, F.lit(1e-8))


def touches_edge(rule: str, x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = 1.0) -> Column:
    """Whether a box touches the image's edge; there are four rules that differ by a pixel or so.

    sample: up to 1 px off; label: only on the edge itself; margin: by a margin on top of the last
    pixel; tile: inclusive last pixel on the edge.
    """
    near, far_x, far_y = {
        "sample": (1, width - 1, height - 1),
        "label": (0, width, height),
        "margin": (margin, width - 1 - margin, height - 1 - margin),
        "tile": (0, width, height),
    }[rule]
    return (x <= near) | (y <= near) | (x + w >= far_x) | (y + h >= far_y)


def sample_score(density: Column, size: Column, quality: Column, adhesion: Column, morphology: Column) -> Column:
    """How telling a sample is by its labels: one point for each uncommon scene, half for the form."""
    point = lambda c, values, k: F.when(c.isin(*values), k).otherwise(0.0)
    return (
        point(density, ("sparse", "dense"), 1.0)
        + point(size, ("small", "wide", "large"), 1.0)
        + point(quality, ("low_contrast", "blurred", "noisy_texture"), 1.0)
        + point(adhesion, ("few_touching", "many_touching"), 1.0)
        + point(morphology, ("irregular", "flake_like", "fiber_like", "porous", "mixed"), 0.5)
    )


def diversity_score(n: Column, adhesion: Column, diameter: Column, aspect: Column, edge: Column) -> Column:
    """How telling an image is by its measured particles."""
    return (
        F.when((n >= 20) & (n < 80), 0.5).otherwise(1.0)
        + F.when(adhesion < 0.01, 0.3).when(adhesion > 0.3, 1.0).otherwise(0.0)
        + F.when((diameter < 20) | (diameter > 80), 0.5).otherwise(0.0)
        + F.when(aspect > 2.5, 1.0).otherwise(0.0)
        + F.when(edge > 0, 1.0).otherwise(0.0)
    )


def selection_score(f1: Column, boundary_iou: Column, mask_iou: Column, recall: Column, precision: Column, n_pred: Column, n_gt: Column, over_split: Column) -> Column:
    """The weighted score by which parameters are ranked."""
    known = F.greatest(n_gt, F.lit(1))
    balance = F.greatest(F.lit(0.0), 1.0 - F.abs(n_pred - n_gt) / known)
    penalty = F.least(over_split / known, F.lit(1.0))
    return 0.35 * f1 + 0.25 * boundary_iou + 0.20 * mask_iou + 0.05 * recall + 0.05 * precision + 0.05 * balance + 0.05 * (1.0 - penalty)


def review_required(f1: Column, mask_iou: Column, boundary_iou: Column, recall: Column, precision: Column) -> Column:
    return (f1 < 0.90) | (mask_iou < 0.85) | (boundary_iou < 0.85) | (recall < 0.90) | (precision < 0.90)


def alignment_failed(pixel_iou: Column, diff_percent: Column, instance_diff: Column) -> Column:
    return (pixel_iou < 0.95) | (diff_percent >= 0.1) | (instance_diff > 2)
