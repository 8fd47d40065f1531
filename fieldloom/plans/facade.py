"""Named operations over DataFrames: ``run(name, df, ...)``; ``describe`` tells what each takes and does."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from fieldloom.functions import expression, scalars
from fieldloom.operators import aggregates as A
from fieldloom.operators import bases as B
from fieldloom.operators import diagnostics as D
from fieldloom.operators import geometry as G
from fieldloom.operators import joins as J
from fieldloom.operators import morphology as M
from fieldloom.operators import probes as P
from fieldloom.operators import recursions as R
from fieldloom.operators import relations as S
from fieldloom.operators import rom
from fieldloom.operators import sampling
from fieldloom.operators import series as T
from fieldloom.operators import trajectories


class Operation(NamedTuple):
    category: str
    run: Callable
    about: str


def _op(category: str, f: Callable) -> Operation:
    return Operation(category, f, (f.__doc__ or "").strip().split("\n")[0])


OPERATIONS: dict[str, Operation] = {
    "reynolds_stats": _op("statistics", A.reynolds),
    "running_moments": _op("statistics", A.running_moments),
    "quantile": _op("statistics", A.quantiles),
    "box_stats": _op("statistics", A.box_stats),
    "quadrant_analysis": _op("statistics", A.quadrants),
    "phase_average": _op("statistics", A.phase_average),
    "stat_convergence": _op("statistics", D.effective_samples),
    "gof_normality": _op("statistics", D.normality),
    "anisotropy_state": _op("statistics", D.anisotropy),
    "surrogate_metrics": _op("validation", A.error_metrics),
    "residual_diagnostics": _op("validation", T.durbin_watson),
    "ensemble_average": _op("validation", A.weighted_ensemble),
    "cell_volume_integrals": _op("integrals", A.volume_integrals),
    "ts_features": _op("features", T.features),
    "change_points": _op("anomaly", R.partition_changes),
    "anomaly_mahalanobis": _op("anomaly", rom.mahalanobis),
    "denoise": _op("preprocessing", T.savgol),
    "safe_eval": _op("preprocessing", expression.safe_eval),
    "time_interp": _op("preprocessing", J.interpolate),
    "two_point_acf": _op("statistics", T.autocorrelation),
    "pod_truncation": _op("rom", T.truncation),
    "rom_residual": _op("rom", rom.reconstruction_error),
    "eof": _op("rom", rom.pod),
    "psd_welch": _op("spectral", R.welch),
    "mass_search": _op("similarity", R.motif_profile),
    "grid_derivatives": _op("topology", T.gradients_2d),
    "conditional_sampling": _op("sampling", A.conditional_average),
    "line_probe": _op("sampling", P.line_probe),
    "hotspots": _op("validation", S.top_k),
    "kolmogorov_slope": _op("spectral", D.power_law),
    "acoustic_strouhal": _op("spectral", D.strouhal),
    "critical_points": _op("topology", D.critical_points),
    "helmholtz_decomp": _op("topology", D.helmholtz),
    "morphology_components": _op("topology", M.components),
    "surface_forces": _op("integrals", G.pressure_forces),
    "plane_flux": _op("integrals", G.plane_flux),
    "coord_transform": _op("preprocessing", scalars.cylindrical),
    "bic_model_average": _op("validation", D.bic_model_average),
    "stacking": _op("validation", D.stacking),
    "morris_sensitivity": _op("validation", sampling.morris_sensitivity),
    "permutation_importance": _op("validation", D.permutation_importance),
    "batch_predict": _op("validation", D.batch_predict),
    "find_motifs": _op("similarity", D.motifs),
    "rom_envelope": _op("rom", rom.envelope),
    "subspace_drift": _op("rom", rom.subspace_drift),
    "gappy_reconstruct": _op("rom", rom.gappy_reconstruct),
    "trajectory_clustering": _op("rom", trajectories.trajectory_clustering),
    "basis_interpolate": _op("rom", B.basis_interpolate),
    "mode_summary": _op("rom", rom.mode_summary),
    "save_rom": _op("rom", rom.save_modes),
    "load_rom": _op("rom", rom.load_modes),
}


def list_operations(category: str | None = None) -> list[str]:
    return sorted(n for n, o in OPERATIONS.items() if category in (None, o.category))


def describe(name: str) -> Operation:
    if name not in OPERATIONS:
        raise KeyError(f"unknown operation {name}; known are {', '.join(list_operations())}")
    return OPERATIONS[name]


def run(name: str, df: DataFrame, *args, **kwargs):
    return describe(name).run(df, *args, **kwargs)
