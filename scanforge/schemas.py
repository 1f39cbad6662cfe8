"""Explicit schemas of the spectral tables."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
_AD, _AL = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())

#: A spectrum: start time in minutes, parallel arrays of m/z and intensity.
SCANS = _struct(("scan_idx", _L), ("ind", _L), ("mslev", _I), ("bpmz", _D), ("bpint", _D), ("starttime", _D), ("mzarray", _AD), ("intarray", _AD))
SCAN_HEADER = _struct(("scan_idx", _L), ("mslev", _I), ("bpmz", _D), ("bpint", _D), ("starttime", _D))

#: A candidate: expected times in minutes, parallel arrays of its pattern's m/z and abundance.
REFERENCE = _struct(
    ("id", _L), ("Modified sequence", _S), ("Charge", _I), ("m/z", _D), ("Mass", _D), ("Length", _I), ("Leading proteins", _S), ("Reverse", _S), ("Intensity", _D),
    ("Retention time", _D), ("Calibrated retention time", _D), ("Calibrated retention time start", _D), ("Calibrated retention time finish", _D),
    ("predicted_RT", _D), ("Retention time new", _D), ("IsoMZ", _AD), ("IsoAbundance", _AD),
)
EXPERIMENT = _struct(
    ("Modified sequence", _S), ("Charge", _I), ("Calibrated retention time start", _D), ("Calibrated retention time finish", _D), ("Calibrated retention time", _D),
    ("Retention time", _D), ("Intensity", _D), ("Reverse", _S),
)
PEAKS = _struct(
    ("scan_idx", _L), ("apex_mzidx", _L), ("apex_mz", _D), ("start_mzidx", _L), ("start_mz", _D), ("end_mzidx", _L), ("end_mz", _D), ("peak_width", _D), ("peak_height", _D),
    ("peak_intensity_sum", _D),
)
DICTIONARY = _struct(("scan_idx", _L), ("apex_mz", _D), ("id", _L), ("abundance", _D))
OBSERVATION = _struct(("scan_idx", _L), ("apex_mz", _D), ("intensity", _D))
ACTIVATION = _struct(("id", _L), ("scan_idx", _L), ("starttime", _D), ("activation", _D), ("cos_dist", _D))
SCAN_RECORD = _struct(
    ("scan_idx", _L), ("starttime", _D), ("candidates_by_rt", _AL), ("filtered_candidates", _AL), ("n_collinear", _L), ("best_alpha", _D), ("cos_dist", _D), ("intensity_explained", _D)
)
ELUTION_PEAKS = _struct(
    ("id", _L), ("apex_scan", _L), ("apex_time", _D), ("start_scan", _L), ("start_time", _D), ("end_scan", _L), ("end_time", _D), ("peak_width", _D), ("peak_height", _D),
    ("peak_intensity_auc", _D), ("rt_search_center_diff", _D), ("closest_to_search_center", _B),
)
