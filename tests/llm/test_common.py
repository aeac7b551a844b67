"""The folder for stored intermediates."""

import pytest

from tidemark.llm.common import shared_folder


class Session:
    def __init__(self, **options):
        self.options = options
        self.conf = self

    def get(self, name, default=None):
        return self.options.get(name, default)


def test_a_cluster_must_name_its_folder():
    assert shared_folder(Session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    local = shared_folder(Session(**{"spark.master": "local[8]"}))
    assert local and shared_folder(Session(**{"spark.master": "local[*]"})) == local
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://h:7077", "k8s://h"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(Session(**{"spark.master": master}))
