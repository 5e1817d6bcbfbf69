"""Bulk jobs against a replay of the reference's one-request-at-a-time logic."""

from hypothesis import given, settings
from hypothesis import strategies as st

from cataloom.operators.images import image_assign
from cataloom.operators.sync import new_files, path_check, sync_stats
from cataloom.schema import FILE_LIST

PATHS = st.sampled_from([f"D:\\r\\{c}.png" for c in "abcdefgh"])


def _catalog(spark, paths):
    rows = [(i + 1, None, None, None, p, None, True, None, None, None, None, None, None)
            for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, FILE_LIST)


@settings(max_examples=12, deadline=None)
@given(st.lists(PATHS, max_size=12), st.lists(PATHS, max_size=8, unique=True))
def test_sync_matches_sequential_model(spark, catalog_paths, disk_paths):
    cat = _catalog(spark, catalog_paths)
    inv = spark.createDataFrame([(p,) for p in disk_paths], "origin_path string")
    # the reference: new = disk paths not in the list; every known row flagged
    # by existence; missing counted after the update
    new = [p for p in disk_paths if p not in catalog_paths]
    flags = [p in disk_paths for p in catalog_paths]
    want_stats = {"total_files_in_directory": len(disk_paths), "new_files_added": len(new),
                  "total_files_in_database": len(catalog_paths) + len(new),
                  "missing_files": flags.count(False)}
    assert sync_stats(cat, inv).first().asDict() == want_stats
    assert sorted(r.origin_path for r in new_files(inv, cat).collect()) == sorted(new)
    got_flags = {r.id: r.path_check for r in path_check(cat, inv).collect()}
    assert [got_flags[i + 1] for i in range(len(catalog_paths))] == flags


UPLOADS = st.lists(st.tuples(st.integers(1, 4), st.booleans()), max_size=14)
EXISTING = st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.integers(0, 5))), max_size=10)


@settings(max_examples=12, deadline=None)
@given(UPLOADS, EXISTING)
def test_image_numbering_matches_sequential_uploads(spark, uploads, existing):
    images = spark.createDataFrame([(i, f, None, s) for i, (f, s) in enumerate(existing)],
                                   "id int, file_list_id int, image string, sort int")
    ups = spark.createDataFrame([(u, f, has) for u, (f, has) in enumerate(uploads)],
                                "upload_id int, file_list_id int, has_file boolean")
    # the reference, one upload at a time: max(sort) of the row, +1 (1 when
    # the maximum is NULL or 0), then the new row is inserted
    table = list(existing)
    want = {}
    for u, (f, has) in enumerate(uploads):
        sorts = [s for g, s in table if g == f and s is not None]
        top = max(sorts) if sorts else None
        sort = top + 1 if top else 1
        want[u] = (sort, f"/images/img{f}_{sort:03d}.png" if has else None)
        table.append((f, sort))
    got = {r.upload_id: (r.sort, r.image) for r in image_assign(ups, images).collect()}
    assert got == want
