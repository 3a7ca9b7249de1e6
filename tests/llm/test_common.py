"""The shared folder of a session without spark.checkpoint.dir."""

from commitgauge.llm.common import shared_folder


class _Conf:
    def get(self, name, default=None):
        return default


class _Context:
    def __init__(self):
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/given"


class _Session:
    conf, sparkContext = _Conf(), _Context()


def test_a_session_without_the_setting_gets_a_checkpoint_folder_once():
    session = _Session()
    first = shared_folder(session)
    assert first.endswith("/given") and shared_folder(session) == first
