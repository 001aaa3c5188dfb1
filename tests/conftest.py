import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pliego.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="pliego-tests")
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pliego-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def tmp_json(tmp_path):
    """Write package documents to a fresh folder; returns a writer."""
    import json

    def write(docs, pretty=False, name="p.json"):
        d = tmp_path / f"pk{len(list(tmp_path.iterdir()))}"
        d.mkdir()
        with open(d / name, "w") as f:
            if pretty:
                json.dump(docs, f, indent=2)
            else:
                for doc in docs:
                    f.write(json.dumps(doc) + "\n")
        return str(d)
    return write
