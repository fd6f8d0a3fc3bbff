import numpy as np

from stepfold.functions import images, reproject

K = np.array([[40.0, 0, 20], [0, 40, 15], [0, 0, 1]])


def view(shift=0.0):
    pose = np.eye(4)
    pose[0, 3] = shift
    return pose


def test_carry_to_the_same_view():
    mask = np.zeros((30, 40), np.uint8)
    mask[10:20, 12:22] = 255
    depth = np.full((30, 40), 2.0, np.float32)
    out = reproject.carry(mask, depth, view(), K, view(), K, (30, 40))
    # the division's small offset moves pixels down by at most one; dilation adds one on each side
    x1, y1, x2, y2 = reproject.box_of(out)
    assert x1 in (10, 11) and y1 in (8, 9) and x2 in (21, 22) and y2 in (19, 20)


def test_carry_follows_the_camera():
    mask = np.zeros((30, 40), bool)
    mask[10:20, 22:32] = True
    depth = np.full((30, 40), 2.0)
    still = reproject.box_of(reproject.carry(mask, depth, view(), K, view(), K, (30, 40)))
    # both directions keep every pixel inside, so the first, camera to world, wins: the camera moves right by 0.5, pixels left by 10
    moved = reproject.box_of(reproject.carry(mask, depth, view(), K, view(0.5), K, (30, 40)))
    assert abs(still[0] - moved[0] - 10) <= 1 and abs(still[2] - moved[2] - 10) <= 1
    # here only world to camera keeps them inside
    other = reproject.carry(np.roll(mask, -20, axis=1), depth, view(), K, view(0.6), K, (30, 40))
    assert reproject.box_of(other)[0] > 10


def test_carry_gives_up():
    depth = np.full((30, 40), 2.0)
    few = np.zeros((30, 40), bool)
    few[0, :9] = True
    full = np.ones((30, 40), bool)
    assert reproject.carry(few, depth, view(), K, view(), K, (30, 40)) is None
    assert reproject.carry(full, depth * 20, view(), K, view(), K, (30, 40)) is None
    assert reproject.carry(full, depth, view(), K, view(), K, (0, 40)) is None
    assert reproject.carry(full, depth, np.zeros((4, 4)), K, np.zeros((4, 4)), K, (30, 40)) is None
    assert reproject.carry(full, depth, view(), np.zeros((3, 3)), view(), K, (30, 40)) is None
    small = np.ones((15, 20), bool)  # another grid is brought to the depth's
    assert reproject.carry(small, depth, view(), K, view(), K, (30, 40)).mean() > 0.9


def test_visible_support():
    depth = np.full((30, 40), 2.0)
    depth[:, 20:] = 0
    seen = reproject.visible([(depth, view(), K), (None, view(), K)], view(), K, (30, 40))
    assert seen[:, :20].all() and not seen[:, 26:].any()
    left, right = np.zeros((30, 40), bool), np.zeros((30, 40), bool)
    left[5:10, 2:10], right[5:10, 30:38] = True, True
    assert reproject.visible_share(left, seen) == 1 and reproject.visible_share(right, seen) == 0
    assert reproject.visible_share(np.zeros((30, 40)), seen) is None
    assert not reproject.visible([], view(), K, (30, 40)).any()


def test_carried_boxes(spark):
    mask, depth = np.zeros((30, 40), np.uint8), np.full((30, 40), 2.0)
    mask[10:20, 12:22] = 1
    flat = [v.ravel().tolist() for v in (view(), K, view(), K)]
    schema = "case_id string, step int, object_id int, mask array<tinyint>, depth array<double>, height int, width int, pose array<double>, k array<double>, to_pose array<double>, to_k array<double>, to_height int, to_width int"
    rows = [("c", 1, i, m.ravel().tolist(), depth.ravel().tolist(), 30, 40, *flat, 30, 40) for i, m in enumerate((mask, mask * 0))]
    got = {r["object_id"]: r["box"] for r in reproject.carried_boxes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: reproject.box_of(reproject.carry(mask, depth, view(), K, view(), K, (30, 40))), 1: None}


def test_edges():
    a = np.zeros((20, 20))
    a[:, 10:] = 200
    found = reproject.edges(a)
    assert found.any(axis=1).all() and found.sum(axis=1).max() == 1 and set(np.nonzero(found)[1]) <= {9, 10}
    flat = np.full((20, 20), 7)
    assert not reproject.edges(flat).any() and reproject.edge_overlap(flat, flat) == 1
    assert reproject.edge_overlap(a, a) == 1 and reproject.edge_overlap(a, flat) == 0
    assert reproject.edge_overlap(a, np.roll(a, 1, axis=1)[:, ::1]) > 0.4
    # a weak edge stays only where it goes on from a strong one
    weak = np.zeros((20, 20))
    weak[:, 10:] = 30
    assert not reproject.edges(weak).any()
    weak[:5, 10:] = 200
    assert reproject.edges(weak)[12].any()


def test_resizing():
    assert images.half_size(np.zeros((7, 5))).shape == (4, 2)
    assert images.resized(np.arange(12).reshape(3, 4), (2, 2)).tolist() == [[0, 2], [4, 6]]
