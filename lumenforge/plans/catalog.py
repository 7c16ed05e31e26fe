"""The catalogue of preprocessing pipelines and the weights of the task profiles, and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transforms

PROFILES = ("auto", "shape", "color", "texture")
#: Weights of the score components by profile; each profile's sum is 1.
WEIGHTS: dict[str, dict[str, float]] = {
    "auto": {"local_contrast": 0.25, "entropy": 0.15, "noise_reduction": 0.20, "sharpness": 0.15, "edge_continuity": 0.15, "clipping_control": 0.10},
    "shape": {"local_contrast": 0.20, "edge_continuity": 0.25, "sharpness": 0.20, "noise_reduction": 0.10, "edge_density": 0.15, "clipping_control": 0.10},
    "color": {"color_preservation": 0.25, "saturation_separation": 0.20, "local_contrast": 0.15, "exposure_balance": 0.20, "clipping_control": 0.20},
    "texture": {"local_contrast": 0.20, "sharpness": 0.20, "entropy": 0.15, "edge_density": 0.20, "noise_reduction": 0.15, "clipping_control": 0.10},
}
COMPONENTS = tuple(sorted({m for w in WEIGHTS.values() for m in w}))


@dataclass(frozen=True)
class Step:
    transform: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    id: str
    profiles: tuple[str, ...]
    steps: tuple[Step, ...]
    rationale: tuple[str, ...] = ()
    cautions: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict, hash=False)

    def display_name(self, language: str = "en") -> str:
        """The name given for a language; without one, the words of the id."""
        return self.names.get(language) or self.id.replace("-", " ").capitalize()


_CLAHE = Step("lab_clahe", {"clip_limit": 2.0, "grid_size": 8})
_GREY = Step("gray_bgr")
#: The ten pipelines, with why one would take them and what to expect.
DEFAULT = (
    Pipeline("baseline-normalize", ("auto", "shape", "color", "texture"), (Step("normalize"),), ("stable_baseline",)),
    Pipeline("lab-clahe", ("auto", "shape", "color", "texture"), (_CLAHE,), ("low_local_contrast",), ("may_amplify_texture",)),
    Pipeline("auto-gamma", ("auto", "color"), (Step("auto_gamma", {"target_midpoint": 0.5}),), ("unbalanced_exposure",), ("may_shift_tones",)),
    Pipeline("gaussian-clean", ("auto", "shape", "texture"), (Step("gaussian", {"kernel_size": 5, "sigma": 0.8}),), ("high_frequency_noise",), ("may_blur_edges",)),
    Pipeline("median-clean", ("auto", "shape", "texture"), (Step("median", {"kernel_size": 5}),), ("impulse_noise",), ("may_remove_small_detail",)),
    Pipeline("bilateral-detail", ("auto", "shape", "color", "texture"), (Step("bilateral", {"diameter": 7, "sigma_color": 45, "sigma_space": 45}),), ("noise_with_edges",), ("higher_processing_cost",)),
    Pipeline("clahe-bilateral", ("auto", "shape", "color", "texture"), (_CLAHE, Step("bilateral", {"diameter": 7, "sigma_color": 40, "sigma_space": 40})), ("low_contrast_and_noise",), ("may_amplify_texture", "higher_processing_cost")),
    Pipeline("unsharp-detail", ("auto", "shape", "texture"), (Step("unsharp", {"kernel_size": 5, "sigma": 1.0, "amount": 0.8, "threshold": 3}),), ("low_sharpness",), ("may_amplify_noise",)),
    Pipeline("gray-clahe-unsharp", ("shape", "texture"), (_GREY, _CLAHE, Step("unsharp", {"kernel_size": 5, "sigma": 1.0, "amount": 0.7, "threshold": 2})), ("shape_priority",), ("color_information_removed",)),
    Pipeline("texture-blackhat", ("texture", "shape"), (_GREY, Step("blackhat", {"kernel_size": 9, "shape": "ellipse"}), Step("normalize")), ("dark_local_structure",), ("not_natural_color_output",)),
)


def check_catalog(pipelines: tuple[Pipeline, ...]) -> tuple[Pipeline, ...]:
    ids = [p.id for p in pipelines]
    if len(set(ids)) < len(ids):
        raise ValueError("pipeline ids must be unique")
    for p in pipelines:
        if not p.steps or not set(p.profiles) <= set(PROFILES):
            raise ValueError(f"{p.id}: no steps, or an unknown profile")
        for s in p.steps:
            transforms.check_config(s.transform, s.params)
    return pipelines


def faults_of_sets(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, faults) of sets of rows (keys, profile, metric, weight): `profile`, `metric`, `number`, `sum`, as far as they hold."""
    odd = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    number = F.coalesce((F.col("weight") >= 0) & (F.col("weight") < float("inf")), F.lit(False))
    by = weights.groupBy(*keys).agg(F.max(odd("profile", PROFILES)).alias("profile"), F.max(odd("metric", COMPONENTS)).alias("metric"), F.max(~number).alias("number"), F.coalesce(F.abs(F.sum("weight") - 1) > 1e-9, F.lit(True)).alias("sum"))
    return by.select(*keys, F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("profile", "metric", "number", "sum")]), lambda x: x.isNotNull()).alias("faults"))


def check_weights(weights: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """The weights themselves, or ValueError with all that is wrong with them: names, numbers, sums."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v < math.inf
    faults = [f"no weights for {p}" for p in PROFILES if not weights.get(p)]
    faults += [f"unknown profile: {p}" for p in weights if p not in PROFILES]
    faults += [f"{p}: unknown metric {m}" for p, own in weights.items() for m in own if m not in COMPONENTS]
    faults += [f"{p}: {m} is no finite number of 0 or more" for p, own in weights.items() for m, v in own.items() if not number(v)]
    faults += [f"{p}: the sum is not 1" for p, own in weights.items() if own and all(map(number, own.values())) and abs(math.fsum(own.values()) - 1) > 1e-9]
    if faults:
        raise ValueError("; ".join(faults))
    return weights


def _names(raw: dict) -> dict[str, str]:
    """Names by language, of keys such as display_name_en."""
    return {k.removeprefix("display_name_"): str(v) for k, v in raw.items() if k.startswith("display_name_") and v}


def load_catalog(path: str) -> tuple[Pipeline, ...]:
    """From YAML: pipelines: [{id, profiles, steps: [{transform, params}]}]."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or not isinstance(raw.get("pipelines"), list):
        raise ValueError("a catalogue has a list of pipelines")
    return check_catalog(tuple(Pipeline(p["id"], tuple(p["profiles"]), tuple(Step(s["transform"], s.get("params") or {}) for s in p["steps"]), tuple(p.get("rationale_codes") or ()), tuple(p.get("warning_codes") or ()), _names(p)) for p in raw["pipelines"]))


def load_weights(path: str) -> dict[str, dict[str, float]]:
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ValueError("weights are a mapping of profiles")
    return check_weights(raw)


def pipelines_table(spark: SparkSession, pipelines: tuple[Pipeline, ...] = DEFAULT) -> DataFrame:
    rows = [(p.id, list(p.profiles), [(i, s.transform, {k: str(v) for k, v in s.params.items()}) for i, s in enumerate(p.steps)], list(p.rationale), list(p.cautions)) for p in pipelines]
    return spark.createDataFrame(rows, "pipeline_id string, profiles array<string>, steps array<struct<step_no:int,transform:string,params:map<string,string>>>, rationale array<string>, cautions array<string>")


def weights_table(spark: SparkSession, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    rows = [(p, i, m, float(v)) for p, own in weights.items() for i, (m, v) in enumerate(own.items())]
    return spark.createDataFrame(rows, "profile string, ordinal int, metric string, weight double")


def apply(pipeline: Pipeline, px: Column, h: Column, w: Column) -> Column:
    """A pipeline of expressions on a grey plane; its steps nest and no step's plane is kept."""
    names = {"kernel_size": "k", "target_midpoint": "target"}
    for s in pipeline.steps:
        if s.transform not in transforms.REGISTRY:
            raise ValueError(f"{s.transform} runs as an Arrow kernel only")
        px = transforms.REGISTRY[s.transform](px, h, w, **{names.get(k, k): v for k, v in s.params.items()})
    return px


def compatible(pipelines: DataFrame, profile: str) -> DataFrame:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    return pipelines.where(F.array_contains("profiles", profile))
