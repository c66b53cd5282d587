"""Prompts for models, built as columns. The keys of the JSON that they ask for are fixed values: the readers of the answers expect them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .coerce import fixed

CONFIRMATION_FORM = '{"confidence": 0.0, "events": [{"event_start": 0.0, "event_end": 0.0, "confidence": 0.0, "visual_evidence": "", "audio_evidence": "", "reason": ""}], "reason": ""}'
SCAN_FORM = '{"candidates": [{"start": 0.0, "end": 0.0, "confidence": 0.0, "visual_evidence": ""}]}'
REVIEW_FORM = '{"event_present": true, "complete": true, "confidence": 0.0, "needs_more_before": false, "needs_more_after": false}'
CONSOLIDATION_FORM = '{"same_occurrence": false, "occurrence_count": 2, "confidence": 0.0, "reason": ""}'


def _number(x: Column, digits: int = 3) -> Column:
    return F.when(x.isNull(), F.lit("unknown")).otherwise(F.format_string(f"%.{digits}f", x))


def _answer(form: str) -> str:
    return f" Answer with one JSON object and nothing else: {form}"


def _times(x: Column) -> Column:
    """Times of an array of structs with a field time, in order."""
    return F.array_join(F.transform(F.array_sort(x), lambda h: F.concat(F.format_string("%.3f", fixed(h["time"])), F.lit(" s"))), "、")


def candidate_note(origin: Column, score: Column, focus_time: Column, audio_score: Column, visual_score: Column, evidence: Column) -> Column:
    """Which signals led to a clip and how far each can be trusted: what a model needs to weigh them."""
    seen = F.coalesce(evidence, F.lit(""))
    sound = F.concat(F.lit("Found by: sound, "), _number(score), F.lit(". Other things sound alike."))
    frames = F.concat(F.lit("Found by: single frames, "), _number(score), F.lit(". Noted there: "), seen)
    step = F.concat(F.lit("Found by: a jump between two frames, "), _number(score), F.lit(", at "), _number(focus_time), F.lit(" s. Decide what made it jump; edits and camera moves don't count."))
    both = F.concat(F.lit("Found by: sound, "), _number(F.coalesce(audio_score, score)), F.lit(", and single frames, "), _number(F.coalesce(visual_score, score)), F.lit(". Noted there: "), seen)
    return F.when(origin == "audio_visual", both).when(origin == "visual_fallback", frames).when(origin == "visual_change", step).otherwise(sound)


def confirmation_prompt(event: Column, note: Column, most: int = C.MAX_EVENTS) -> Column:
    """Asks for every new occurrence of an event in a clip, as the JSON that `confirmation.local_events` reads."""
    task = F.concat(F.lit("Event: “"), event, F.lit("”. Does it begin in this clip, by picture and sound? "), note)
    rules = f" Give each beginning its own entry ({most} entries at most, by time), from the first to the last moment of what happens. Leave out what had begun before the clip."
    return F.concat(task, F.lit(rules + _answer(CONFIRMATION_FORM)))


def scan_prompt(event: Column, hints: Column, interval: float = C.SCAN_INTERVAL, sounds: Column | None = None) -> Column:
    """Asks where an event may happen in a sparse replay; `hints` and `sounds` (arrays of structs that begin with a field time) are named in time order."""
    known = F.when(F.size(hints) > 0, F.concat(F.lit(" Jumps between frames: "), _times(hints), F.lit("."))).otherwise("")
    heard = F.lit("") if sounds is None else F.when(F.size(sounds) > 0, F.concat(F.lit(" Sounds that may belong to it: "), _times(sounds), F.lit("."))).otherwise("")
    task = F.concat(F.lit("Event: “"), event, F.lit(f"”. This replay has one frame for {interval:g} seconds of the source, stamped with its time. Where could the event be? Give times of the source."))
    return F.concat(task, known, heard, F.lit(_answer(SCAN_FORM)))


def review_prompt(event: Column, focus_start: Column, focus_end: Column) -> Column:
    """Asks whether a clip shows the whole event, as the JSON that `reviews` reads."""
    place = F.concat(F.lit("” is expected between "), _number(fixed(focus_start, 2), 2), F.lit(" and "), _number(fixed(focus_end, 2), 2), F.lit(" seconds of this clip. Is it there, and does the clip reach from before it to after it?"))
    return F.concat(F.lit("“"), event, place, F.lit(_answer(REVIEW_FORM)))


def consolidation_prompt(event: Column, parts: Column) -> Column:
    """Asks whether neighbouring ranges (array of structs with start and end) of a clip are one occurrence; when in doubt they are several."""
    ranges = F.array_join(F.transform(parts, lambda r: F.concat(_number(r["start"], 2), F.lit("-"), _number(r["end"], 2), F.lit(" s"))), "、")
    task = F.concat(F.lit("“"), event, F.lit("” was found in neighbouring ranges of this clip: "), ranges, F.lit(". Does one occurrence run through all of them, or does it begin anew? Traces that merely remain are no beginning. Without clear evidence, call them separate."))
    return F.concat(task, F.lit(_answer(CONSOLIDATION_FORM)))
