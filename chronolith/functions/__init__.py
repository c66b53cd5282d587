"""Column functions: no Python on the data path."""

from .bounds import clip_bounds, padded_bounds, source_core, tolerant_bounds  # noqa: F401
from .coerce import as_bool, as_confidence, fixed, http_date, ratio, retry_after_seconds, retryable_download, retryable_model, variant_bool  # noqa: F401
from .intervals import contains, iou, overlap_fraction, required_interval, same_core, valid_interval  # noqa: F401
from .text import canonical_json, clean_html, clock, clock_seconds, json_object, json_object_or_summary, json_sha256, license_matches, message_text, range_label, required_text, safe_name  # noqa: F401
