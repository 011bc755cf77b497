"""Every query of the plans against its SQL on the smallest tables, and properties that need no oracle."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilescope import plans
from tilescope.operators import raster as R
from tilescope.sources import headers as H

ORACLE = plans.oracle_sql()


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(v) is True else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf, name):
    got, want = plans.queries()[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_orientations_form_a_group():
    every = range(1, 9)
    assert all(R.compose(1, o) == o == R.compose(o, 1) for o in every)
    assert all(R.compose(R.inverse(o), o) == 1 for o in every)
    assert all(R.compose(R.compose(a, b), c) == R.compose(a, R.compose(b, c)) for a in every for b in every for c in every)


def test_halving_keeps_a_constant(spark):
    px = spark.createDataFrame([(0, x, y, 77) for x in range(7) for y in range(5)], "image int, x int, y int, v int")
    half = R.halve(px, R.dims(px), ["v"]).collect()
    assert len(half) == 12 and {r.v for r in half} == {77}


def _paeth(rows: list[bytes], kinds: list[int], step: int) -> bytes:
    """Filter rows by the definition, to be undone."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = bytearray()
        for k, v in enumerate(row):
            a, b, c = (row[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
        out += bytes([kind]) + bytes(line)
        above = row
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(1, 4))
def test_png_filters_round_trip(seed, height, step):
    rng = random.Random(seed)
    lines = [rng.randbytes(step * 5) for _ in range(height)]
    kinds = [rng.randrange(5) for _ in range(height)]
    assert H.unfilter_png(_paeth(lines, kinds, step), step * 5, step) == b"".join(lines)


def test_streams_agree_with_batch(spark, sf):
    batch = plans.queries()["debounce"](spark, sf).toPandas()
    stream = plans.queries()["stream_debounce"](spark, sf).toPandas()
    assert rows(stream[["session", "idx", "ts"]]) == rows(batch[["session", "idx", "ts"]])


def test_playback_of_requests_close_together(spark, tmp_path):
    """Requests at the same time, and closer than a frame lasts: the query equals its SQL, the operator by itself a plain player."""
    import datetime

    import duckdb

    from tilescope.streaming import requests as S

    rng, delays = random.Random(5), (100, 250, 400, 100)
    gaps = (0, 0, 0.4, 1, 58.87, 99, 100, 101, 250, 849, 850, 949, 950, 1249, 1250, 90_000)
    events, times = [], {}
    for user in range(12):
        at = datetime.datetime(2024, 1, 1)
        for k in range(60):
            at += datetime.timedelta(milliseconds=rng.choice(gaps))
            events.append((user + 12 * k, at, user, "view", 1.0, None))
            times.setdefault(user, []).append((at - datetime.datetime(1970, 1, 1)) // datetime.timedelta(milliseconds=1))
    rng.shuffle(events)
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(events, S.EVENTS).repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert rows(plans.queries()["stream_playback"](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLE["stream_playback"]).df())
    got = {(r.session, r.seq): r.frame for r in S.drain(S.advances(S.request_stream(spark, path), delays), "append").collect()}
    want = {}
    for user, every in times.items():
        frame, due = 0, every[0] + delays[0]
        for k, now in enumerate(every):
            due = now if now - due >= sum(delays) else due
            while due <= now:
                frame = (frame + 1) % len(delays)
                due += delays[frame]
            want[user, user + 12 * k] = frame
    assert got == want


def test_written_pyramid_equals_the_planned_one(spark, sf, tmp_path):
    from tilescope.sources import fixtures as X
    from tilescope.sources import tiles

    px = X.pixels(spark, sf)
    tiles.write_pyramid(px, str(tmp_path / "p"), 3, tile=16)
    read = spark.read.parquet(str(tmp_path / "p")).select("image", "x", "y", *R.RGBA, "level").toPandas()
    assert rows(read) == rows(R.pyramid(px, 3).toPandas())
    some = tiles.read_tiles(spark, str(tmp_path / "p"), 0, (0, 1), (0, 0))
    assert some.count() == px.where("x < 32 and y < 16").count()


def test_sizes_at_ties_round_as_c_does(spark, sf):
    from pyspark.sql import functions as F

    from tilescope.functions import text as T

    def c_size(n):
        if n < 1000:
            return f"{n} B"
        return f"{n / 1e3:.0f} kB" if n < 999_500 else f"{n / 1e6:.1f} MB" if n < 999_950_000 else f"{n / 1e9:.1f} GB"

    sizes = [0, 1, 999, 1000, *range(1500, 1_000_000, 1000), 999_499, 999_500, *range(1_050_000, 1_000_000_000, 100_000), 999_949_999, 999_950_000]
    sizes += [k * 50_000_000 for k in range(20, 4000)] + [10**15 + 50_000_000, 2**62]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", T.human_size(F.col("n")).alias("shown")).collect()
    assert {r.n: r.shown for r in got} == {n: c_size(n) for n in sizes}
    assert plans.queries()["human_size"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_header_sizes_look_at_documents(spark, tmp_path):
    texts = ["plain", "BM" + "x" * 40, "GIF89a" + "ab" * 4, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: (r.width, r.height) for r in plans.queries()["header_sizes"](spark, str(tmp_path)).collect()}
    four, two = 0x78787878, 0x6261
    assert got == {2: (500, 300), 6: (500, 160), 7: (1600, 1200), 1001: (four, four), 1002: (two, two)}


def plain_lru(log, budget):
    """Accesses one by one, with a list in order of last use."""
    held, out = [], []
    for key, size, pinned in log:
        hit = any(k == key for k, _, _ in held)
        held = [e for e in held if e[0] != key] + [(key, size, pinned)]
        gone = 0
        for e in [e for e in held if not e[2] and e[0] != key]:
            if sum(x[1] for x in held) <= budget:
                break
            held.remove(e)
            gone += 1
        out.append((hit, gone, sum(x[1] for x in held)))
    return out


def test_lru_log_equals_a_plain_replay(spark, sf):
    from tilescope.operators import sessions as S
    from tilescope.plans import stateful

    rng = random.Random(4)
    logs = {c: [(rng.randrange(9), rng.randrange(1, 6) * 1000, rng.random() < 0.1) for _ in range(150)] for c in range(4)}
    rows_ = [(c, k, *a) for c, log in logs.items() for k, a in enumerate(log)]
    got = S.lru_log(spark.createDataFrame(rows_, "cache bigint, seq bigint, key bigint, bytes bigint, pinned boolean").repartition(3), 12_000).collect()
    assert {(r.cache, r.seq): (r.hit, r.evicted, r.held) for r in got} == {(c, k): x for c, log in logs.items() for k, x in enumerate(plain_lru(log, 12_000))}
    # and the query, over its whole table
    from tilescope.sources import fixtures as X

    logs = {}
    for r in sorted(X.requests(spark, sf).collect(), key=lambda r: (r.session % 200, r.generation * 1000000 + r.session)):
        logs.setdefault(r.session % 200, []).append((r.idx, (r.idx % 7 + 1) * 1000, r.idx % 10 == 0))
    want = sorted((c, *x) for c, log in logs.items() for x in plain_lru(log, 12_000))
    assert sorted((r.cache, r.hit, r.evicted, r.held) for r in stateful.tile_lru(spark, sf).collect()) == want


def plain_trim(entries, budget, spare):
    far = sorted((e for e in entries if e["rank"] >= 1 << 20), key=lambda e: (-e["used"], e["idx"]))[spare:]
    items = [dict(e) for e in sorted(entries, key=lambda e: e["idx"]) if e not in far]
    for e in items:
        if e["rank"] > 1:
            e["whole"] = e["frames"] = 0
    size = lambda e: e["preview"] + e["whole"] + e["frames"]
    while sum(map(size, items)) > budget:
        able = [e for e in items if e["rank"] > 1 and size(e)]
        if not able:
            break
        items.remove(max(able, key=lambda e: (e["rank"], -e["used"], -e["idx"])))
    for part in ("frames", "whole"):
        for e in items:
            if sum(map(size, items)) > budget and e["rank"] > 0:
                e[part] = 0
    return items


@pytest.mark.parametrize("budget", [500, 2_000, 9_000, 30_000])
def test_trim_equals_a_plain_version(spark, budget):
    from tilescope.operators import cache as K

    rng = random.Random(budget)
    names = ("session", "idx", "rank", "used", "preview", "whole", "frames")
    every = []
    for session in range(30):
        ranks = rng.sample([0, 1, 2, 3, 4, 7, 7 + 1] + [1 << 20] * 6, 9)
        every += [(session, k, r, rng.randrange(20), rng.choice([0, 500]), rng.choice([0, 1000, 2500]), rng.choice([0, 700])) for k, r in enumerate(ranks)]
    got = K.trim(spark.createDataFrame(every, "session bigint, idx int, rank int, used bigint, preview bigint, whole bigint, frames bigint").repartition(3), budget, 2).collect()
    want = [tuple(e[n] for n in names) for s in range(30) for e in plain_trim([dict(zip(names, e, strict=True)) for e in every if e[0] == s], budget, 2)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_play_controls_equal_a_plain_player(spark, sf):
    from tilescope.plans import timeline

    delays = {}
    for r in sorted(timeline.starts(spark, sf).collect(), key=lambda r: (r.image, r.number)):
        delays.setdefault(r.image, []).append(r.delay)
    got = {(r.image, r.seq): (r.number, r.playing) for r in timeline.play_controls(spark, sf).collect()}
    whats = ("tick", "tick", "toggle", "tick", "seek", "tick", "step", "back")
    for image, some in delays.items():
        frame, due, playing = 0, some[0], True
        for n in range(1, 3 * len(some) + 1):
            now, what, share = n * 190, whats[(image + n) % 8], (image + n) % 11 / 8
            if what == "tick" and playing and now >= due:
                due = now if now - due >= sum(some) else due
                while due <= now:
                    frame = (frame + 1) % len(some)
                    due += some[frame]
            elif what == "toggle":
                playing, due = not playing, now + some[frame]
            elif what == "seek":
                target = int(min(share, 1) * sum(some))
                frame = max(k for k in range(len(some)) if sum(some[:k]) <= target)
                due = now + some[frame]
            elif what in ("step", "back"):
                playing, frame = False, (frame + (1 if what == "step" else -1)) % len(some)
            assert got[image, n] == (frame, playing), (image, n)
    assert len(got) == sum(3 * len(d) for d in delays.values())


def test_cache_changes_equal_a_plain_cache(spark, sf):
    from tilescope.plans import viewing
    from tilescope.sources import fixtures as X

    whats = ("put", "put", "reoriented", "put", "forget", "put", "rebuild", "stream_all")
    got = {(r.session, r.seq): (r.files, r.held, r.width, r.turned) for r in viewing.cache_changes(spark, sf).collect()}
    held, mode = {}, {}
    events = sorted(X.requests(spark, sf).collect(), key=lambda r: (r.session % 40, r.generation * 1000000 + r.session))
    for r in events:
        mine, what, file = held.setdefault(r.session % 40, {}), whats[r.idx % 8], r.idx % 12
        side, streamed = r.idx * 37 + r.generation, r.generation % 2 == 0
        if what == "put":
            mine[file] = {"bytes": r.idx * 100, "streamed": streamed, "w": side, "h": side + 5, "turn": r.idx % 8 + 1}
        elif what in ("forget", "rebuild"):
            mine.pop(file, None)
        elif what == "reoriented" and file in mine:
            e, new = mine[file], r.idx % 8 + 1
            if (e["turn"] > 4) != (new > 4):
                e["w"], e["h"] = e["h"], e["w"]
            e["turn"] = new
        elif what == "stream_all" and mode.get(r.session % 40, False) != streamed:
            mode[r.session % 40] = streamed
            held[r.session % 40] = mine = {f: e for f, e in mine.items() if e["streamed"] and e["w"] * e["h"] > 500_000}
        e = mine.get(file)
        assert got[r.session % 40, r.generation * 1000000 + r.session] == (len(mine), sum(x["bytes"] for x in mine.values()), e and e["w"], e and e["turn"])
    assert len(got) == len(events)


def test_checksums_equal_zlib(spark, sf):
    import zlib

    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    assert {r.c_custkey: r.crc for r in plans.queries()["crc32"](spark, sf).collect()} == {k: zlib.crc32(n.encode()) for k, n in names.items()}


def test_unfiltered_rows_equal_a_plain_loop(spark, sf):
    import zlib

    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    for r in plans.queries()["paeth_unfilter"](spark, sf).collect():
        line, above, out = (names[r.id] + "*" * 24)[:24].encode(), bytes(24), b""
        for kind in range(5):
            now = bytearray()
            for k, v in enumerate(line):
                a, b, c = (now[k - 3] if k >= 3 else 0), above[k], (above[k - 3] if k >= 3 else 0)
                guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now.append((v + (0, a, b, (a + b) // 2, guess)[kind]) & 255)
            above, out = bytes(now), out + bytes(now)
        assert (r.bytes, r.crc) == (120, zlib.crc32(out))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 140), st.integers(0, 255)), max_size=20), st.booleans())
def test_packed_planes_unpack(runs, literal):
    packed, plain = b"", b""
    for n, v in runs:
        if literal and n <= 128:
            part = bytes((v + k) & 255 for k in range(n))
            packed, plain = packed + bytes([n - 1]) + part, plain + part
        elif 3 <= n <= 130:
            packed, plain = packed + bytes([n + 125, v]), plain + bytes([v]) * n
    assert H.unpack_runs(packed) == plain


def test_run_length_bitmaps():
    assert H.bmp_rle(bytes.fromhex("0341 0003424344 00 0000 0545 0001"), 8, 2) == b"AAABCD\0\0EEEEE\0\0\0"
    # two pixels a byte: a run of five, an odd literal, a move, a cut move
    assert H.bmp_rle(bytes.fromhex("0512 0003ABC0 0000 00020100 0234 0002"), 8, 2, nibbles=True) == bytes([1, 2, 1, 2, 1, 10, 11, 12]) + bytes([0, 3, 4, 0, 0, 0, 0, 0])
    assert H.bmp_rle(b"\x09\x07", 4, 1) == b"\x07" * 4 and H.bmp_rle(b"\x00\x02", 4, 1) == bytes(4) and H.bmp_rle(b"\x00\x05\x01", 4, 1) == bytes(4)


def test_jpeg_walk_stops_where_it_must():
    from tilescope.sources import probes as P

    assert list(H.jpeg_segments(b"")) == [] == list(H.jpeg_segments(b"\xff\xd8\xff\xe0\0\x09abc"))
    assert list(H.jpeg_segments(b"\xff\xd8\xff\xff\xff\xe1\0\3a\xff\xda\0\4ab\xff\xe0\0\2")) == [("E1", 8, 1)]
    assert P.jpeg(b"\xff\xd8\xff\xd9") is None and P.png(b"\x89PNG") is None and P.webp(b"RIFF") is None and P.jxl(b"\xff\x0a") is None and P.bmp(b"BM") is None and P.icon(b"icns") is None and P.heif(b"") is None


def test_jxl_sides_of_every_length(spark, tmp_path):
    """Sides around 8,192 and 262,144, where their fields get longer, and up to 30 bits."""
    import duckdb

    sizes = [1, 50, 1156, 1157, 1158, 37_435, 37_436, 37_437, 100_000_000]
    parts = [(key, sizes[k % 9]) for k, key in enumerate([*range(8_180, 8_210), *range(8_990, 9_010), *range(17_180, 17_205), 1_199_993])]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert rows(plans.queries()["probe_jxl"](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLE["probe_jxl"]).df())


def test_probes_of_cut_files_end():
    """Every beginning of a file gives an answer or none, never an error."""
    from tilescope.sources import probes as P
    from tilescope.sources import reorient as R

    rng = random.Random(17)
    heads = {"Jpeg": b"\xff\xd8\xff\xe2", "Png": P.PNG_MAGIC, "WebP": b"RIFF\x40\0\0\0WEBPVP8X", "Jxl": b"\xff\x0a", "Bmp": b"BM", "Ico": b"\0\0\1\0\3\0", "Icns": b"icns\0\0\1\0", "Heif": b"\0\0\0\x18ftypheic\0\0\0\0\0\0\0\0\0\0\0\x40meta"}
    for kind, head in heads.items():
        for _ in range(300):
            data = head + rng.randbytes(rng.randrange(90))
            P.PROBES[kind](data)
            P.mpf_images(data), P.heif_colour(data), P.restart_index(data), P.gain_map_iso(data), P.jxl_gain_map(data)
            try:
                R.reoriented(data, kind, rng.randrange(1, 9))
            except R.Refused:
                pass


#: Published conversions between linear RGB spaces (ITU-R BT.2087 and the P3 of DCI at D65), to four places.
PUBLISHED = {
    ("bt2020", "bt709"): ((1.6605, -0.5876, -0.0728), (-0.1246, 1.1329, -0.0083), (-0.0182, -0.1006, 1.1187)),
    ("bt709", "bt2020"): ((0.6274, 0.3293, 0.0433), (0.0691, 0.9195, 0.0114), (0.0164, 0.0880, 0.8956)),
    ("p3", "bt709"): ((1.2249, -0.2249, 0.0), (-0.0421, 1.0421, 0.0), (-0.0196, -0.0786, 1.0983)),
}


def test_conversions_are_the_published_ones(spark, sf):
    got = {(r.source, r.target, r.i, r.j): r.value for r in plans.queries()["matrix"](spark, sf).collect()}
    for (a, b), m in PUBLISHED.items():
        assert all(abs(got[a, b, i, j] - m[i][j]) < 2e-4 for i in range(3) for j in range(3)), (a, b)
    names = {k[0] for k in got}
    for a in names:  # there and back is where one was, and white stays white
        for b in names:
            assert all(abs(sum(got[a, b, i, k] * got[b, a, k, j] for k in range(3)) - (i == j)) < 1e-4 and abs(sum(got[a, b, i, k] for k in range(3)) - 1) < 1e-5 for i in range(3) for j in range(3))


def test_packed_sizes_equal_a_plain_loop(spark, sf):
    import zlib

    from tilescope.sources import fixtures as X

    tiles = {}
    for p in X.pixels(spark, sf).collect():
        tiles.setdefault((p.image, p.x // 16, p.y // 16), {})[p.x % 16, p.y % 16] = (p.r, p.g, p.b, p.a)
    got = {(r.image, r.column, r.row): (r.raw, r.planes) for r in plans.queries()["blob_sizes"](spark, sf).collect()}
    assert set(got) == set(tiles)
    for key, px in tiles.items():
        w, h = 1 + max(x for x, _ in px), 1 + max(y for _, y in px)
        split = lambda x, y: (lambda r, g, b, a: ((r - g) % 256, g, (b - g) % 256, a))(*px[x, y])
        planes = bytes((split(x, y)[c] - (split(x, y - 1)[c] if y else 0)) % 256 for c in range(4) for y in range(h) for x in range(w))
        assert got[key] == (4 * w * h, len(zlib.compress(planes, 1)))


def test_an_unreadable_tile_is_a_hole(spark):
    from tilescope.operators import blob as T

    rows_ = [(0, 0, 0, 2, 2, bytearray(range(16))), (0, 1, 0, 2, 2, bytearray(b"cut")), (0, 0, 1, 1, 1, None)]
    tiles = spark.createDataFrame(rows_, T.SCHEMA)
    got = {(r.column, r.row): bytes(r[5]) for r in T.map_tiles(tiles, lambda a: a).collect()}
    assert got == {(0, 0): bytes(range(16)), (1, 0): bytes(16), (0, 1): bytes(4)}
