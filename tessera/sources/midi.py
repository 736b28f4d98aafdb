"""Standard MIDI files as notes, and notes as Standard MIDI files.

Reading: every file of a folder tree whose name ends in .mid or .midi, in any case, in the order of paths. Ticks become
seconds by the tempo map of all tracks. A note-on with velocity 0 ends a note. A note-off ends all open notes of its channel
and pitch that began before it. Notes still open at the end of a track are left out. Channel 10 is drums; a program holds for
the notes of its channel that begin after it. A file that can't be parsed has no rows.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, ord long, start_sec double, end_sec double, pitch long, program long, is_drum boolean, velocity long"
DEFAULT_TEMPO = 500_000  # microseconds a quarter note
DRUM_CHANNEL = 9


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        b = data[at]
        at += 1
        value = value << 7 | b & 127
        if b < 128:
            return value, at


def _events(track: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tick, status, data); for meta events the status is 0xFF00 + type."""
    at = tick = status = 0
    while at < len(track):
        delta, at = _number(track, at)
        tick += delta
        if track[at] >= 0x80:
            status = track[at]
            at += 1
        if status == 0xFF:
            kind = track[at]
            size, at = _number(track, at + 1)
            yield tick, 0xFF00 + kind, track[at : at + size]
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _number(track, at)
            at += size
        elif status < 0x80:
            raise ValueError("data byte without a status")
        else:
            size = 1 if status >> 4 in (0xC, 0xD) else 2
            yield tick, status, track[at : at + size]
            at += size


def parse(data: bytes) -> list[tuple[float, float, int, int, bool, int]]:
    """(start, end, pitch, program, is_drum, velocity) in the order in which notes end within their tracks."""
    if data[:4] != b"MThd":
        raise ValueError("not a Standard MIDI file")
    size, _, n_tracks, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000:
        raise ValueError("frames a second aren't supported")
    at, tracks = 8 + size, []
    while at + 8 <= len(data) and len(tracks) < n_tracks:
        kind, length = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        if kind == b"MTrk":
            tracks.append(list(_events(data[at + 8 : at + 8 + length])))
        at += 8 + length
    tempos = sorted((tick, int.from_bytes(d, "big")) for t in tracks for tick, s, d in t if s == 0xFF51 and len(d) == 3)
    marks = [(0, 0.0, DEFAULT_TEMPO)]
    for tick, tempo in tempos:
        last, sec, per = marks[-1]
        marks.append((tick, sec + (tick - last) * per / division / 1e6, tempo))
    ticks = [m[0] for m in marks]

    def seconds(tick: int) -> float:
        last, sec, per = marks[bisect_right(ticks, tick) - 1]
        return sec + (tick - last) * per / division / 1e6

    notes = []
    for track in tracks:
        program = [0] * 16
        held: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for tick, status, d in track:
            kind, channel = status >> 4, status & 15
            if status >= 0xFF00:
                continue
            if kind == 0xC:
                program[channel] = d[0]
            elif kind == 0x9 and d[1]:
                held.setdefault((channel, d[0]), []).append((tick, d[1], program[channel]))
            elif kind in (0x8, 0x9):
                key = (channel, d[0])
                for begun, velocity, prog in held.get(key, []):
                    if begun < tick:
                        notes.append((seconds(begun), seconds(tick), d[0], prog, channel == DRUM_CHANNEL, velocity))
                held[key] = [x for x in held.get(key, []) if x[0] >= tick]
    return notes


def read_midi(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Notes of a folder tree; ``limit`` takes the first files by path, before any is parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(r"\.midi?$"))
    if limit is not None:
        first = files.select("path").orderBy("path").limit(limit)
        files = files.join(F.broadcast(first), "path", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    notes = parse(content or b"")
                except (ValueError, IndexError, struct.error):
                    continue
                if notes:
                    cols = list(zip(*notes, strict=True))
                    n = len(notes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array(range(n), pa.int64()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int64())],
                        names=["path", "ord", "start_sec", "end_sec", "pitch", "program", "is_drum", "velocity"],
                    )

    return files.select("path", "content").mapInArrow(run, SCHEMA).withColumnRenamed("path", "file_id")


def _coded(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def render(notes: list[tuple[float, float, int, int, bool, int]], division: int = 1000) -> bytes:
    """A file with one track for each instrument, at half a second a quarter note: a tick is 0.5 ms."""
    tracks = [[(0, b"\xff\x51\x03" + DEFAULT_TEMPO.to_bytes(3, "big"))]]
    per_sec = division * 1e6 / DEFAULT_TEMPO
    channels = [c for c in range(16) if c != DRUM_CHANNEL]
    for k, (program, drum) in enumerate(sorted({(n[3], n[4]) for n in notes})):
        channel = DRUM_CHANNEL if drum else channels[k % len(channels)]
        events = [(0, bytes([0xC0 | channel, program & 127]))]
        for start, end, pitch, p, d, velocity in notes:
            if (p, d) == (program, drum):
                a, b = round(start * per_sec), round(end * per_sec)
                events += [(a, bytes([0x90 | channel, pitch, velocity])), (max(b, a + 1), bytes([0x80 | channel, pitch, 0]))]
        tracks.append(sorted(events, key=lambda e: (e[0], e[1][0] & 0xF0)))
    out = [b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), division)]
    for events in tracks:
        body, last = [], 0
        for tick, data in events:
            body.append(_coded(tick - last) + data)
            last = tick
        body.append(b"\0\xff\x2f\0")
        out.append(b"MTrk" + struct.pack(">I", sum(map(len, body))) + b"".join(body))
    return b"".join(out)


def to_midi(notes: DataFrame) -> DataFrame:
    """(file_id, content) from notes in seconds; a file is a bounded group."""
    kind = notes.schema["file_id"].dataType.simpleString()

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = zip(*(t[c].to_pylist() for c in ("start_sec", "end_sec", "pitch", "program", "is_drum", "velocity")), strict=True)
        return pa.table({"file_id": pa.array([key[0].as_py()], t["file_id"].type), "content": pa.array([render(list(rows))], pa.binary())})

    return notes.groupBy("file_id").applyInArrow(run, f"file_id {kind}, content binary")
