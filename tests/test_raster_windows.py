"""Windows of GeoTIFF files: what they read, and that they hold what a whole decode holds."""

import struct
import zlib

import numpy as np
import pytest

from quillspan.sources import geotiff, readers


def lzw(data):
    """The inverse of geotiff.lzw()."""
    table, width, bits, n, out = {bytes([k]): k for k in range(256)}, 9, 0, 0, bytearray()
    next_code = 258

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n)
            bits &= (1 << n) - 1

    put(256)
    held = b""
    for k in range(len(data)):
        more = held + data[k : k + 1]
        if more in table:
            held = more
            continue
        put(table[held])
        table[more] = next_code
        next_code += 1
        if next_code >= (1 << width) and width < 12:
            width += 1
        if next_code == 4095:
            put(256)
            table, width, next_code = {bytes([k]): k for k in range(256)}, 9, 258
        held = data[k : k + 1]
    if held:
        put(table[held])
        next_code += 1
        if next_code >= (1 << width) and width < 12:
            width += 1
    put(257)
    if n:
        out.append(bits << (8 - n) & 0xFF)
    return bytes(out)


def predicted(block, predictor):
    if predictor == 2:
        whole = block.view(f"{block.dtype.str[0]}u{block.itemsize}").astype(f"u{block.itemsize}")
        return np.diff(whole, axis=1, prepend=whole.dtype.type(0)).astype(f"{block.dtype.str[0]}u{block.itemsize}").tobytes()
    if predictor == 3:
        planes = np.ascontiguousarray(block.astype(f">f{block.itemsize}")).view(np.uint8).reshape(*block.shape, block.itemsize).transpose(0, 2, 1).reshape(block.shape[0], -1)
        return np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
    return block.tobytes()


def tiff(images, tile=None, strip=3, way=1, predictor=1, order="<", big=False, west=90.0, north=25.0, step=0.5):
    """A file of an image and its overviews, in tiles or strips."""
    word, out = ("Q" if big else "I"), bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42))
    if big:
        out += struct.pack(f"{order}HH", 8, 0)
    hook = len(out)
    out += struct.pack(f"{order}{word}", 0)
    pack = {1: lambda b: b, 5: lzw, 8: zlib.compress}[way]
    for image in images:
        h, w = image.shape
        bw, bh = tile or (w, strip)
        places, sizes = [], []
        for r in range(0, h, bh):
            for c in range(0, w, bw):
                block = image[r : r + bh, c : c + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1])))
                raw = pack(predicted(np.ascontiguousarray(block), predictor))
                places.append(len(out))
                sizes.append(len(raw))
                out += raw
        kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [image.itemsize * 8]), (259, 3, [way]), (317, 3, [predictor]), (339, 3, [kind])]
        fields += [(322, 4, [bw]), (323, 4, [bh]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [bh]), (279, 4, sizes)]
        fields += [(33550, 12, [step, step, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
        entries = b""
        for tag, type_, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{({3: 'H', 4: 'I', 12: 'd'})[type_]}", *values)
            if len(raw) > struct.calcsize(word):
                at = len(out)
                out += raw
                raw = struct.pack(f"{order}{word}", at)
            entries += struct.pack(f"{order}HH{word}", tag, type_, len(values)) + raw.ljust(struct.calcsize(word), b"\0")
        out[hook : hook + struct.calcsize(word)] = struct.pack(f"{order}{word}", len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + entries
        hook = len(out)
        out += struct.pack(f"{order}{word}", 0)
    return bytes(out)


CASES = [
    dict(tile=(16, 16)), dict(strip=7), dict(tile=(16, 32), way=8, predictor=2), dict(tile=(32, 16), way=5, predictor=2), dict(way=5, strip=4), dict(tile=(16, 16), way=8, predictor=3),
    dict(tile=(16, 16), way=5, order=">", predictor=2), dict(tile=(16, 16), way=8, big=True), dict(strip=64, way=8, order=">", big=True, predictor=2),
]


@pytest.mark.parametrize("case", CASES, ids=str)
@pytest.mark.parametrize("kind", ["u1", "i2", "f4"])
def test_whole_files_in_every_layout(case, kind):
    if case.get("predictor") == 3 and kind != "f4" or case.get("predictor") == 2 and kind == "f4":
        pytest.skip("the predictor is for other values")
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(-3, 4, (50, 70)), axis=1).astype(f"{case.get('order', '<')}{kind}" if kind != "u1" else "u1")
    got, layout = geotiff.decode(tiff([values], **case))
    assert np.array_equal(got, values.astype(float)) and (layout.west, layout.north, layout.step_x) == (90.0, 25.0, 0.5)


def test_lzw_of_all_code_widths():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"a" * 10_000, rng.bytes(20_000), bytes(rng.integers(0, 4, 60_000, dtype=np.uint8))):
        assert geotiff.lzw(lzw(data), len(data)) == data
    with pytest.raises(ValueError):
        geotiff.lzw(b"\xff" * 40, 100)


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    rng = np.random.default_rng(3)
    values = rng.integers(-50, 3000, (400, 300)).astype("<i2")
    path = tmp_path_factory.mktemp("tif") / "a.tif"
    path.write_bytes(tiff([values, values[::2, ::2].copy(), values[::4, ::4].copy()], tile=(32, 32), way=8, predictor=2, step=0.01))
    return str(path), np.maximum(values.astype(float), 0)


def read(df):
    return {(r.row, r.col): r.value for r in df.collect()}


@pytest.mark.parametrize("window", [(0, 0, 5, 5), (30, 31, 3, 70), (390, 290, 20, 20), (-4, -3, 10, 10), (500, 500, 3, 3), (0, 0, 400, 300)])
def test_a_window_equals_the_whole_decode(spark, file, window):
    path, values = file
    row0, col0, height, width = window
    got = read(readers.read_raster_window(spark, path, *window))
    inside = lambda r, c: values[r, c] if 0 <= r < 400 and 0 <= c < 300 else 0.0
    assert got == {(r, c): inside(row0 + r, col0 + c) for r in range(height) for c in range(width)}


def test_bytes_read_grow_with_the_window(file, monkeypatch):
    path, _ = file
    read_bytes = []
    real = geotiff.opened

    def counting(p):
        fetch = real(p)
        return lambda at, n: (read_bytes.append(n), fetch(at, n))[1]

    monkeypatch.setattr(geotiff, "opened", counting)

    def cost(**options):
        read_bytes.clear()
        reader = geotiff._WindowReader({"path": path, **{k: str(v) for k, v in options.items()}})
        parts = reader.partitions()
        planned = sum(read_bytes)  # directories alone
        rows = sum(b.num_rows for p in parts for b in reader.read(p))
        return rows, sum(read_bytes) - planned * (1 + len(parts)), len(parts)

    small, wide, whole = cost(row_min=40, row_max=60, col_min=40, col_max=60), cost(row_min=40, row_max=60), cost(blocks=20)
    assert (small[0], wide[0], whole[0]) == (21 * 21, 21 * 300, 400 * 300)
    assert small[1] * 8 < wide[1] < whole[1] / 10 and whole[2] == 7
    assert cost(row_min=70, row_max=40)[:2] == (0, 0)
    assert cost(level=2)[0] == 100 * 75


def test_overviews_share_the_place(spark, file):
    path, values = file
    half = readers.read_raster(spark, path, (10, 12), (20, 21), level=1).collect()
    assert {(r.row, r.col): r.value for r in half} == {(r, c): values[2 * r, 2 * c] for r in (10, 11, 12) for c in (20, 21)}
    assert {round(r.lat, 9) for r in half} == {round(25.0 - (r + 0.5) * 0.02, 9) for r in (10, 11, 12)}
    with pytest.raises(Exception, match="no overview 3"):
        readers.read_raster(spark, path, level=3).count()


def test_filters_narrow_the_window(spark, file):
    """With Spark's switch for pushing filters to Python sources, fewer blocks are planned, and results stay the same."""
    path, values = file
    key = "spark.sql.python.filterPushdown.enabled"
    ask = lambda: readers.read_raster(spark, path, blocks=1).filter("lat between 23.5 and 24.0 and lon > 92.2 and row != 120")
    plain, tasks = read(ask()), ask().rdd.getNumPartitions()
    spark.conf.set(key, "true")
    try:
        assert read(ask()) == plain and ask().rdd.getNumPartitions() * 4 < tasks == 130
    finally:
        spark.conf.unset(key)
    lat, lon = (lambda r: 25.0 - (r + 0.5) * 0.01), (lambda c: 90.0 + (c + 0.5) * 0.01)
    assert plain == {(r, c): values[r, c] for r in range(400) for c in range(300) if 23.5 <= lat(r) <= 24.0 and lon(c) > 92.2 and r != 120}
