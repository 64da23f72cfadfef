"""Look-ahead smoothing: a pixel keeps its colour while that is near enough, else takes one that lasts.

Pixels don't depend on each other once the blur is known, so a clip's frames are cut into tiles of pixels. A tile's
frames stream past in order, sorted by Spark; of them five are held, and for each pixel what it shows. So a task's
memory is a tile's, however long the clip is. ``smoothing_stream`` does the same to a stream of frames, with that
state kept between micro-batches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cadenza.functions import pixels

#: Frames seen at once, and the weights of a promised stay by its length (fixed values).
LOOK_AHEAD = 5
STAY_WEIGHTS = np.array([0, 40, 80, 100, 110])
#: Least and most importance of a pixel that changes, by how many frames the new colour lasts (fixed values).
CHANGE_WEIGHTS = np.array([[10, 110], [5, 80], [15, 190], [50, 205], [50, 205]])
NO_BACKGROUND = 1 << 20
TILE_PIXELS = 4096


def importance(distance: np.ndarray, threshold: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    over = np.maximum(distance - threshold, 0)
    return least + np.minimum(over * most // (threshold * 48), most)


def typical(slots: np.ndarray, lasts: np.ndarray, all_slots: bool = False) -> np.ndarray:
    """Per channel, the middle of the first lasts + 1 slots (1 to 5), means of two rounded down. For four and five slots
    the usual choice looks at the first three only: the mean of the upper two, and the largest; ``all_slots`` takes
    true medians."""
    x = slots.astype(np.int64)
    s3 = np.sort(x[:3], axis=0)
    if all_slots:
        s4, s5 = np.sort(x[:4], axis=0), np.sort(x[:5], axis=0)
        four, five = (s4[1] + s4[2]) // 2, s5[2]
    else:
        four, five = (s3[1] + s3[2]) // 2, s3[2]
    choices = [x[0], (x[0] + x[1]) // 2, s3[1], four, five]
    return np.choose(lasts[:, None], choices).astype(np.uint8)


class Smoother:
    """The smoothing of some pixels, frame after frame: each push of a frame gives the one of four pushes before."""

    #: What is kept between frames.
    STATE = ("colour", "soft", "solid", "shown", "is_shown", "promised", "stayed", "counts")

    def __init__(self, n: int, quality: int = 100, all_slots: bool = False):
        self.base, self.all_slots = (55 - quality // 2) ** 2, all_slots
        self.colour, self.soft = np.zeros((LOOK_AHEAD, n, 3), np.uint8), np.zeros((LOOK_AHEAD, n, 3), np.uint8)
        self.solid = np.zeros((LOOK_AHEAD, n), bool)
        self.shown, self.is_shown = np.zeros((n, 3), np.uint8), np.zeros(n, bool)
        self.promised, self.stayed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.counts = np.zeros(2, np.int64)  # frames pushed, frames given

    def push(self, rgba: np.ndarray, blur: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Of a frame's pixels (n, 4) and their blur (n, 3): the smoothed pixels and importance of the frame that is due."""
        self._append(rgba[:, :3], blur, rgba[:, 3] >= 128)
        self.counts[0] += 1
        return self._next(bool(self.counts[0] & 1)) if self.counts[0] >= LOOK_AHEAD else None

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The frames that are still due when no more come."""
        for _ in range(LOOK_AHEAD - int(self.counts[0] - self.counts[1])):  # until the frame that is due comes first
            self._append(0, 0, False)
        while self.counts[1] < self.counts[0]:
            yield self._next(bool(self.counts[1] + LOOK_AHEAD - 1 & 1))
            self._append(0, 0, False)

    def _append(self, colour: np.ndarray | int, soft: np.ndarray | int, solid: np.ndarray | bool) -> None:
        for ring, new in ((self.colour, colour), (self.soft, soft), (self.solid, solid)):
            ring[:-1] = ring[1:]
            ring[-1] = new

    def _next(self, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        now, soft, own = self.colour[0], self.soft[0], self.solid[0]
        shown, is_shown, promised, stayed = self.shown, self.is_shown, self.promised, self.stayed
        turn = (now[:, 0] // 2 > now[:, 1]) != (now[:, 2] > 127)
        limit = np.where(turn != odd, self.base, 2 * self.base)
        raw, mild = pixels.distance(shown, now), pixels.distance(shown, soft)
        off = np.where(is_shown, np.where(raw < mild, raw, (raw + mild) // 2), NO_BACKGROUND)

        cleared = ~own & is_shown
        promised[cleared] = 0
        stays = own & (stayed < promised)
        least = ((limit < 300) & (stayed < 3)) | ((limit >= 300) & (limit < 500) & (stayed < 2)) | ((limit >= 400) & (limit < 900) & (stayed < 1))
        most = np.where(stayed > 0, 0, STAY_WEIGHTS[np.minimum(promised, 4)])
        weight = np.where(stays, importance(off, limit, least.astype(np.int64), most), cleared)

        fresh = np.flatnonzero(own & ~stays & (off >= limit))
        run, lasts = np.ones(len(fresh), bool), np.zeros(len(fresh), np.int64)
        for i in range(1, LOOK_AHEAD):
            like = (pixels.distance(self.colour[i, fresh], now[fresh]) < limit[fresh]) | (pixels.distance(self.soft[i, fresh], soft[fresh]) < limit[fresh])
            run &= self.solid[i, fresh] & like
            lasts[run] = i
        weight[fresh] = importance(off[fresh], limit[fresh], *CHANGE_WEIGHTS[lasts].T)
        stayed[stays] += 1
        shown[fresh] = typical(self.colour[:, fresh], lasts, self.all_slots)
        long = fresh[lasts > 0]
        promised[long], stayed[long] = lasts[lasts > 0], 0
        is_shown &= own
        is_shown[fresh] = True
        self.counts[1] += 1
        out = np.where(own[:, None], np.concatenate([shown, np.full((len(own), 1), 255, np.uint8)], axis=1), 0)
        return out.astype(np.uint8), weight.astype(np.uint8)

    def saved(self) -> bytes:
        """The state as bytes (``restored`` reads them)."""
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.STATE})
        return out.getvalue()

    @classmethod
    def restored(cls, data: bytes, quality: int = 100, all_slots: bool = False) -> Smoother:
        own = cls(0, quality, all_slots)
        with np.load(io.BytesIO(data)) as found:
            for k in cls.STATE:
                setattr(own, k, found[k])
        return own


def smooth(rgba: np.ndarray, blur: np.ndarray, quality: int = 100, all_slots: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of pixels (frames, pixels, 4) and their blur (frames, pixels, 3): the smoothed ones and their importance."""
    own = Smoother(rgba.shape[1], quality, all_slots)
    found = [x for x in map(own.push, rgba, blur) if x] + [*own.flush()]
    return np.stack([x for x, _ in found]), np.stack([w for _, w in found])


def _arrays(rgba: bytes, blur: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(rgba, np.uint8).reshape(-1, 4), np.frombuffer(blur, np.uint8).reshape(-1, 3)


def tiled(frames: DataFrame, tile_pixels: int = TILE_PIXELS, more: tuple[str, ...] = ()) -> DataFrame:
    """clip_id, frame_index, tile (int), rgba, blur and the columns ``more``: frames with ``blur`` cut into tiles."""
    names = ["clip_id", "frame_index", *more]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tiles, data, soft = [], [], [], []
            for i, (rgba, blur) in enumerate(zip(batch.column("rgba").to_pylist(), batch.column("blur").to_pylist())):
                for k, a in enumerate(range(0, len(rgba) // 4, tile_pixels)):
                    rows.append(i)
                    tiles.append(k)
                    data.append(rgba[4 * a : 4 * (a + tile_pixels)])
                    soft.append(blur[3 * a : 3 * (a + tile_pixels)])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(tiles, pa.int32()), pa.array(data, pa.binary()), pa.array(soft, pa.binary())], names=[*names, "tile", "rgba", "blur"])

    rows = frames.select("clip_id", F.col("frame_index").cast("long").alias("frame_index"), *more, "rgba", "blur")
    schema = rows.select(*names).schema.add("tile", "integer").add("rgba", "binary").add("blur", "binary")
    return rows.mapInArrow(cut, schema)


def smoothed(frames: DataFrame, quality: int = 100, all_slots: bool = False, tile_pixels: int = TILE_PIXELS) -> DataFrame:
    """``rgba`` smoothed and ``importance`` (binary, a byte a pixel) of frames with ``blur`` (see ``frames.with_blur``).

    All frames of a clip have the size of its first; others are an error. Other columns are kept. Two shuffles:
    tiles to (clip, tile), and back to frames. Of a tile's frames, in order, a task holds five.
    """
    keep = [c for c in frames.columns if c not in ("rgba", "blur", "importance")]
    names = ["clip_id", "frame_index", "tile", "rgba", "importance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, due, out = None, None, [], []

        def give(found: tuple[np.ndarray, np.ndarray] | None) -> None:
            if found:
                out.append((place[0], due.pop(0), place[1], found[0].tobytes(), found[1].tobytes()))

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            kinds = [batch.column("clip_id").type, pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            for row in batch.to_pylist():
                rgba, blur = _arrays(row["rgba"], row["blur"])
                if (row["clip_id"], row["tile"]) != place:
                    for x in own.flush() if own else ():
                        give(x)
                    place, own, due = (row["clip_id"], row["tile"]), Smoother(len(rgba), quality, all_slots), []
                if own.colour.shape[1] != len(rgba):
                    raise ValueError("a clip's frames must be of one size")
                due.append(row["frame_index"])
                give(own.push(rgba, blur))
            if out:
                yield batch_of()
        for x in own.flush() if own else ():
            give(x)
        if out:
            yield batch_of()

    tiles = tiled(frames, tile_pixels)
    schema = tiles.select("clip_id", "frame_index", "tile", "rgba").schema.add("importance", "binary")
    done = tiles.repartition("clip_id", "tile").sortWithinPartitions("clip_id", "tile", "frame_index").mapInArrow(run, schema)
    parts = F.array_sort(F.collect_list(F.struct("tile", "rgba", "importance")))
    joined = done.groupBy("clip_id", "frame_index").agg(parts.alias("parts"))
    glue = lambda c: F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p[c])), ""))
    joined = joined.select("clip_id", "frame_index", glue("rgba").alias("rgba"), glue("importance").alias("importance"))
    return frames.select(*keep).join(joined, ["clip_id", "frame_index"])


class TileProcessor(StatefulProcessor):
    """Smooths one (clip, tile) of a stream: between micro-batches it keeps five frames and what each pixel shows."""

    def __init__(self, quality: int, all_slots: bool, quiet: float):
        self.quality, self.all_slots, self.quiet_ms = quality, all_slots, round(quiet * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tile", "pixels binary, due array<long>")

    def _give(self, key: tuple, given: list[tuple]) -> Iterator[pd.DataFrame]:
        if given:
            yield pd.DataFrame([(*key, *x) for x in given], columns=["clip_id", "tile", "frame_index", "rgba", "importance"])

    def _flushed(self, own: Smoother, due: list[int]) -> list[tuple]:
        self.state.clear()
        return [(i, x.tobytes(), w.tobytes()) for i, (x, w) in zip(due, own.flush())]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        own, due = (Smoother.restored(bytes(found[0]), self.quality, self.all_slots), list(found[1])) if found else (None, [])
        given = []
        frames = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        for i, rgba, blur, last in zip(*(frames[c] for c in ("frame_index", "rgba", "blur", "is_last"))):
            rgba, blur = _arrays(rgba, blur)
            own = own or Smoother(len(rgba), self.quality, self.all_slots)
            if own.colour.shape[1] != len(rgba):
                raise ValueError("a clip's frames must be of one size")
            due.append(int(i))
            if x := own.push(rgba, blur):
                given.append((due.pop(0), x[0].tobytes(), x[1].tobytes()))
            if last:
                given += self._flushed(own, due)
                own, due = None, []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if own:
            self.state.update((own.saved(), due))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield from self._give(key, given)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        if found:
            yield from self._give(key, self._flushed(Smoother.restored(bytes(found[0]), self.quality, self.all_slots), list(found[1])))


def smoothing_stream(frames: DataFrame, quality: int = 100, all_slots: bool = False, tile_pixels: int = TILE_PIXELS, quiet: float = 60.0) -> DataFrame:
    """``smoothed`` over a stream of frames (clip_id, frame_index, rgba, blur, is_last), each clip's in order: clip_id, tile,
    frame_index, rgba, importance of the tiles, a frame four frames after it came.

    A clip ends with its frame that ``is_last``, or when none came for ``quiet`` seconds: then the frames still due are
    given and nothing is kept. Needs the RocksDB state store.
    """
    tiles = tiled(frames, tile_pixels, ("is_last",))
    kind = frames.schema["clip_id"].dataType.simpleString()
    schema = f"clip_id {kind}, tile int, frame_index long, rgba binary, importance binary"
    return tiles.groupBy("clip_id", "tile").transformWithStateInPandas(TileProcessor(quality, all_slots, quiet), schema, "append", "processingTime")
