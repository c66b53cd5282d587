"""Media tools behind adapters: commands as plain lists, run where the rows are."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import wave
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def run(command: list[str], timeout: float = 600.0) -> str:
    """Standard output and error of a command; an error that names the tool if it is missing or fails."""
    if shutil.which(command[0]) is None:
        raise RuntimeError(f"{command[0]} is not installed")
    done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]} failed: {done.stderr.strip()[-500:]}")
    return done.stdout + done.stderr


#: Codecs and their options by the clip's extension (fixed values of the tool): clips for viewing, and clips of free formats for data sets.
FORMATS = {
    ".mp4": ("-c:v", "libx264", "-pix_fmt", "yuv420p", "-c:a", "aac", "-movflags", "+faststart"),
    ".webm": ("-c:v", "libvpx-vp9", "-b:v", "0", "-crf", "32", "-c:a", "libopus"),
}


def _transcode(path: str, out: str, options: tuple[str, ...], *, ahead: tuple[str, ...] = ()) -> list[str]:
    """ffmpeg without questions and with errors only; `ahead` applies to the input."""
    return ["ffmpeg", "-nostdin", "-loglevel", "error", *ahead, "-i", path, *options, "-y", out]


def probe_command(path: str) -> list[str]:
    """A report of the container and its streams as JSON, for `readers.probes`."""
    return ["ffprobe", "-loglevel", "error", "-print_format", "json", "-show_format", "-show_streams", path]


def audio_command(path: str, out: str, rate: int = C.SAMPLE_RATE) -> list[str]:
    """What a detector reads: the sound alone as a WAV file, one channel, 16-bit samples at its rate."""
    return _transcode(path, out, ("-map", "0:a:0", "-ac", "1", "-ar", f"{rate}", "-sample_fmt", "s16", "-f", "wav"))


def scene_command(path: str, threshold: float = 0.05) -> list[str]:
    """A log of frames that differ from the one before by more than the threshold, for `readers.scene_hints`: the filters print to standard output, no file is made."""
    return ["ffmpeg", "-nostdin", "-loglevel", "info", "-i", path, "-vf", f"select=gt(scene\\,{threshold:g}),metadata=mode=print:file=-", "-an", "-f", "null", "-"]


def sparse_command(path: str, out: str, interval: float = C.SCAN_INTERVAL, playback: int = 4, width: int = 640) -> list[str]:
    """A silent replay of one frame for every `interval` seconds, `playback` of them a second.

    Frames are picked, not blended, so that each shows one moment. They're scaled
    before the clock is drawn, so its size doesn't depend on the source's. The clock is the
    source's, as times are changed last.
    """
    steps = (
        f"select=isnan(prev_selected_t)+gte(t-prev_selected_t\\,{interval:g})",
        f"scale={width}:-2",
        "drawtext=text=%{pts\\\\:hms}:fontsize=h/12:fontcolor=yellow:borderw=2:x=w/40:y=h-1.5*th",
        f"setpts=N/({playback}*TB)",
    )
    return _transcode(path, out, ("-filter:v", ",".join(steps), "-r", f"{playback}", "-an", *FORMATS[".mp4"][:4], *FORMATS[".mp4"][6:]))


def cut_command(path: str, out: str, offset: float, seconds: float) -> list[str]:
    """A clip of `seconds` from `offset`, with the first picture and the first sound, which must both be there; the codecs follow from the file's extension.

    Seeking in the input is exact, as the clip is encoded anew.
    """
    if offset < 0 or seconds <= 0:
        raise ValueError("a clip starts at 0 or later and lasts")
    codecs = FORMATS.get(os.path.splitext(out)[1].lower(), FORMATS[".mp4"])
    return _transcode(path, out, ("-map", "0:v:0", "-map", "0:a:0", *codecs), ahead=("-ss", f"{offset:.3f}", "-t", f"{max(C.MIN_CUT_SECONDS, seconds):.3f}"))


def _finished(out: str, make) -> dict:
    """The path and size of a file that `make` writes under another name first, so a failure leaves nothing."""
    stem, ext = os.path.splitext(out)
    part = f"{stem}.part{ext}"
    try:
        make(part)
        os.replace(part, out)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return {"path": out, "size": os.path.getsize(out)}


class Probe:
    """Answers a row's path with its probe report, which `readers.probes` reads."""

    def __call__(self, row: dict) -> dict:
        return json.loads(run(probe_command(row["path"])))


class SceneLog:
    """Answers a row's path with its log of scene changes, which `readers.scene_hints` reads."""

    def __call__(self, row: dict) -> dict:
        return {"log": run(scene_command(row["path"]))}


class AudioExtractor:
    """Writes the sound of each row's path to its out, as the detector needs it."""

    def __init__(self, rate: int = C.SAMPLE_RATE):
        self.rate = rate

    def __call__(self, row: dict) -> dict:
        return _finished(row["out"], lambda part: run(audio_command(row["path"], part, self.rate)))


class SparseReplay:
    """Writes the sparse replay of each row's path to its out."""

    def __call__(self, row: dict) -> dict:
        return _finished(row["out"], lambda part: run(sparse_command(row["path"], part)))


class Cutter:
    """Cuts each row's clip (path, out, offset, seconds): MP4 for viewing, WebM for data sets."""

    def __call__(self, row: dict) -> dict:
        return _finished(row["out"], lambda part: run(cut_command(row["path"], part, row["offset"], row["seconds"])))


class Detector:
    """Scores each row's WAV file (path): {"scores": frames x classes} of a sound model.

    `model` takes float samples in [-1, 1) and returns a score of each class for each
    frame. Files of another rate or sample width are refused; several channels are averaged.
    """

    def __init__(self, model: Callable[[np.ndarray], np.ndarray], rate: int = C.SAMPLE_RATE):
        self.model, self.rate = model, rate

    def __call__(self, row: dict) -> dict:
        with wave.open(row["path"], "rb") as f:
            if f.getframerate() != self.rate or f.getsampwidth() != 2:
                raise RuntimeError(f"16-bit samples at {self.rate} Hz are needed")
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
        scores = np.asarray(self.model(x.mean(axis=1).astype(np.float32) / 32768), float)
        if scores.ndim != 2:
            raise RuntimeError("scores of frames and classes are needed")
        return {"scores": scores.tolist()}


def detector_frames(scores: DataFrame, keys: list[str], labels: list[tuple[str, int]], threshold: float = C.AUDIO_THRESHOLD) -> DataFrame:
    """keys, frame_idx, start, end, score, top_label, label_scores of frames (answer: a `Detector`'s JSON) whose best wanted label reaches the threshold.

    `labels`: the wanted labels with their class, from a configuration; ties go to the first. A frame is one row throughout.
    """
    each = scores.select(*keys, F.posexplode(F.from_json("answer", "scores array<array<double>>")["scores"]).alias("frame_idx", "_row"))
    wanted = F.array(*(F.struct(F.get("_row", F.lit(i)).alias("score"), F.lit(-pos).alias("order"), F.lit(label).alias("label")) for pos, (label, i) in enumerate(labels)))
    d = each.withColumn("_wanted", wanted).withColumn("_top", F.array_max("_wanted")).where(F.col("_top.score") >= threshold)
    start = F.col("frame_idx") * F.lit(C.FRAME_HOP)
    pairs = F.map_from_entries(F.array_sort(F.transform("_wanted", lambda w: F.struct(w["label"].alias("label"), w["score"].alias("score")))))
    return d.select(*keys, "frame_idx", start.alias("start"), (start + C.FRAME_DURATION).alias("end"), F.col("_top.score").alias("score"), F.col("_top.label").alias("top_label"), pairs.alias("label_scores"))
