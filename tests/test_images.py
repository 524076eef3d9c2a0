import numpy as np

from libroflow.functions import kernels
from libroflow.operators import images


def page(h=60, w=80):
    img = np.full((h, w), 230, np.uint8)
    for y in (10, 30, 50):
        img[y : y + 4, 10:70] = 20
    return img


def test_windows():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 255, (9, 11)).astype(np.uint8)
    wide = np.pad(img, 1, mode="edge")
    each = lambda f: np.array([[f(wide[y : y + 3, x : x + 3]) for x in range(11)] for y in range(9)])
    assert (kernels.dilate(img, 3) == each(np.max)).all() and (kernels.erode(img, 3) == each(np.min)).all() and (kernels.median(img, 3) == each(np.median)).all()


def test_components():
    rng = np.random.default_rng(2)
    mask = rng.random((25, 25)) < 0.35
    seen, want = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for i in range(max(0, a - 1), min(25, a + 2)):
                for j in range(max(0, b - 1), min(25, b + 2)):
                    if mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        stack.append((i, j))
        ys, xs = zip(*cells)
        want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(cells)))
    assert sorted(kernels.components(mask)) == sorted(want)


def test_angles_and_shears():
    img = page()
    assert kernels.level_angle(img) == 0 and kernels.level_angle(kernels.rotated(img, 4, 230)) in (-5, -4, -3)
    bars = np.full((40, 60), 255, np.uint8)
    bars[:, 20:23] = 0
    bars[:, 40:43] = 0
    slanted = kernels.sheared(bars, 1.0, 255)
    assert abs(kernels.deslant(slanted)[0] + 1.0) < 0.21 and kernels.deslant(bars)[0] == 0.0
    assert kernels.line_score((255.0 - img).sum(axis=1)) == float("inf") and kernels.line_score(np.array([0, 9, 1, 8, 0, 9, 1, 9, 0.5])) < 10


def test_thresholds():
    img = page()
    assert 20 <= kernels.otsu(img) < 230 and ((img <= kernels.otsu(img)) == (img == 20)).all()
    assert kernels.stretched(np.array([[10, 20, 30]], np.uint8)).tolist() == [[0, 128, 255]] and kernels.shrunk(4000, 4000, 6_000_000) == (2250, 2250)
    blank = np.full((200, 40), 255, np.uint8)
    blank[:50, :] = 0
    assert kernels.signature_rows(blank, 100) == [(50, 199)]


def test_tables(spark):
    img, colour = page(), np.stack([page()] * 3, axis=-1)
    rows = [(1, 60, 80, img.tobytes()), (2, 60, 80, None), (3, 5, 5, b"xx")]
    df = spark.createDataFrame([(k, h, w, None if d is None else bytearray(d), "clash") for k, h, w, d in rows], "image_id bigint, height int, width int, pixels binary, angle string")
    assert [(r.image_id, r.top) for r in images.strokes(df, 10).collect()] == [(1, 10), (1, 30), (1, 50)]
    assert images.levelled(df).first().angle == 0 and images.deslanted(df).count() == images.binarized_pages(df).count() == 1
    assert images.folios(df).count() == 0 and images.signatures(df, 200).count() == 0 and images.strokes(df.limit(0)).count() == 0
    coloured = spark.createDataFrame([(1, 60, 80, bytearray(colour.tobytes()))], "image_id bigint, height int, width int, pixels binary")
    out = np.frombuffer(images.pooled(coloured).first().pixels, np.uint8).reshape(60, 80)
    assert out[5, 5] > 200 and out[12, 30] < 100
    box = spark.createDataFrame([(1, 60, 8, 200, 20)], "image_id bigint, left int, top int, right int, bottom int")
    part = images.cropped(df, box).first()
    assert (part.right, part.bottom, bytes(part.pixels)) == (80, 20, img[8:20, 60:80].tobytes())
