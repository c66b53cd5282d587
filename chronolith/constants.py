"""Contract values of the event analytics (fixed values)."""

SAMPLE_RATE = 16000
FRAME_DURATION = 0.96
FRAME_HOP = 0.48
AUDIO_THRESHOLD = 0.10
AUDIO_PADDING = 0.50
AUDIO_MERGE_GAP = 0.24
MAX_CANDIDATES = 3
MIN_CONFIDENCE = 0.55
RETRY_PADDING = 1.0
EVENT_PADDING = 1.0
SCAN_INTERVAL = 2.0
VISUAL_PADDING = 2.0
SCENE_MAX_HINTS = 12
SCENE_MIN_SCORE = 0.20
SCENE_PRE_PADDING = 0.25
SCENE_MAX_CANDIDATES = 2
MIN_VISUAL_CONFIDENCE = 0.30
WINDOW_SECONDS = 8.0
WINDOW_OVERLAP = 1.0
MAX_EVENTS = 6
NMS_IOU = 0.50
NMS_OVERLAP = 0.80
DEDUPE_IOU = 0.50
DEDUPE_OVERLAP = 0.80
DEDUPE_LENGTH_RATIO = 2.0
FUSION_IOU = 0.50
BOUND_TOLERANCE = 0.25
COVERAGE_MARGIN = 0.5
TECHNICAL_TOLERANCE = 0.75
MIN_CUT_SECONDS = 0.1
MATCH_IOU = 0.10
STRICT_MATCH_IOU = 0.50
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
PIPELINE_VERSION = 9
EVALUATION_VERSION = 4
SCAN_CACHE_VERSION = 1
CONFIRMATION_CACHE_VERSION = 2
SUCCESSFUL_STATUSES = ("completed", "no_candidate", "no_confirmed_event")
