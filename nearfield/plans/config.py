"""Index configuration, its validation, and the rules that follow from sizes."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

MAX_DIMENSIONS = 16_384
METRICS = ("l2sq", "cosine", "ip")
INDEX_TYPES = ("ivf_f32", "ivf_u8", "tree_f32", "tree_u8")
#: Dimensions looked at between pruning checks, until no more than a share of the candidates is left; then 64 at a time.
WARMUP_STEPS = (16, 16, 32, 32, 32, 32, 64, 64, 64, 64, 128, 128, 128, 128, 256, 256, 512, 1024, 2048)
GROUP = 64
WARMUP_SHARE = 0.2
EPSILON = 1.5


@dataclass(frozen=True)
class IndexConfig:
    """num_clusters and num_meso_clusters 0: chosen from the number of rows. sampling 0: all rows below 30,720, else 0.3."""

    num_dimensions: int
    index_type: str = "ivf_f32"
    metric: str = "l2sq"
    normalize: bool = True
    seed: int = 42
    num_clusters: int = 0
    num_meso_clusters: int = 0
    sampling: float = 0.0
    kmeans_iters: int = 10
    hierarchical: bool = True
    meso_probe_fraction: float = 0.5
    append_probe_fraction: float = 0.125
    train_rows_per_cluster: int = 256
    rotation: str = "dense"
    epsilon: float = EPSILON

    def __post_init__(self) -> None:
        if not 1 <= self.num_dimensions <= MAX_DIMENSIONS:
            raise ValueError(f"num_dimensions must be 1 to {MAX_DIMENSIONS}")
        if self.index_type not in INDEX_TYPES:
            raise ValueError(f"index_type must be one of {INDEX_TYPES}")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if not 0 <= self.sampling <= 1:
            raise ValueError("sampling must be 0 to 1")
        if self.num_clusters < 0 or self.num_meso_clusters < 0:
            raise ValueError("cluster counts can't be negative")
        if self.num_clusters and self.num_meso_clusters and self.num_meso_clusters >= self.num_clusters:
            raise ValueError("num_meso_clusters must be less than num_clusters")
        if not 1 <= self.kmeans_iters <= 99:
            raise ValueError("kmeans_iters must be 1 to 99")
        if self.rotation not in ("dense", "dct", "none"):
            raise ValueError("rotation must be dense, dct or none")
        if self.epsilon < 0:
            raise ValueError("epsilon can't be negative")

    @property
    def normalizes(self) -> bool:
        return self.normalize or needs_normalizing(self.metric)

    @property
    def quantized(self) -> bool:
        return self.index_type.endswith("u8")

    @property
    def tree(self) -> bool:
        return self.index_type.startswith("tree")

    def clusters_for(self, rows: int) -> int:
        if self.num_clusters > rows:
            raise ValueError(f"num_clusters {self.num_clusters} exceeds the {rows} rows")
        return self.num_clusters or min(auto_clusters(rows), rows)

    def as_dict(self) -> dict:
        return asdict(self)


def needs_normalizing(metric: str) -> bool:
    """Cosine and inner product are searched as squared L2 on unit vectors."""
    return metric in ("cosine", "ip")


def auto_clusters(rows: int) -> int:
    factor = 2 if rows < 500_000 else 4 if rows < 2_500_000 else 8
    return math.ceil(factor * math.sqrt(rows))


def auto_meso_clusters(clusters: int) -> int:
    return max(1, math.isqrt(clusters))


def auto_sampling(rows: int) -> float:
    return 1.0 if rows < 30_720 else 0.3


def dimension_split(d: int) -> tuple[int, int]:
    """(vertical, horizontal): dimensions scanned one at a time and in groups of 64."""
    if d <= GROUP:
        return d, 0
    h = int(d * (0.25 if d <= 128 else 0.75))
    h = (h + GROUP // 2) // GROUP * GROUP
    if h == d:
        h = GROUP
    return d - h, h


def prune_ratio(t: int, d: int, epsilon: float = EPSILON) -> float:
    """How far a partial distance over t of d rotated dimensions may lie below the threshold; 1 at both ends."""
    if t <= 0 or t >= d:
        return 1.0
    return t / d * (1 + epsilon / math.sqrt(t)) ** 2


def prune_steps(d: int) -> list[int]:
    """Numbers of dimensions at which candidates are checked, d last."""
    at, out = 0, []
    for step in (*WARMUP_STEPS, *[GROUP] * (d // GROUP + 1)):
        at = min(d, at + step)
        out.append(at)
        if at == d:
            return out
    return out


def capacity(rows: int) -> tuple[int, int]:
    """(least, most) live rows of a cluster made with `rows` rows, before it is merged or split."""
    return rows // 2, max(int(rows * 1.3), 256)
