import pytest

from textmill.config import Settings, for_target
from textmill.plans.stages import Job, Stage


def make(folder, cfg, calls):
    def step(name):
        def run(cfg, path):
            calls.append(name)
            if cfg.get("fail") == name:
                raise RuntimeError("no")
            with open(path, "w") as f:
                f.write(name)

        return run

    stages = [Stage("parse", step("parse"), "parse.json", ("source_lang",)), Stage("segment", step("segment"), "segments.json", ("bullets",), after="parse"), Stage("translate", step("translate"), "ru.json", ("model",), after="segment")]
    return Job(stages, cfg, "hash", str(folder))


def test_resume_and_signatures(tmp_path):
    calls = []
    cfg = {"source_lang": "zh", "bullets": "x", "model": "m"}
    assert make(tmp_path, cfg, calls).run() == ["parse", "segment", "translate"]
    assert make(tmp_path, cfg, calls).run(resume=True) == []
    assert make(tmp_path, cfg | {"model": "n"}, calls).run(resume=True) == ["translate"]
    assert make(tmp_path, cfg | {"bullets": "y"}, calls).run(resume=True) == ["segment", "translate"]
    (tmp_path / "segments.json").write_text("changed")
    assert not make(tmp_path, cfg | {"bullets": "y"}, calls).done("segment")


def test_failure_and_limit(tmp_path):
    calls = []
    with pytest.raises(RuntimeError):
        make(tmp_path, {"fail": "segment"}, calls).run()
    job = make(tmp_path, {}, calls)
    assert job.start("translate") == 0 or job.start("translate") == 1
    job.run(limited=True, wanted="parse")
    assert not job.done("translate")
    other = Job(job.stages, {}, "other", str(tmp_path))
    assert not other.done("parse")


def test_settings():
    assert Settings.from_dict({"llm_batch_max_items": 7, "unknown": 1, "target_lang": None}).batch_max_items == 7
    assert Settings.shipped().batch_max_chars == 4000
    assert Settings(context_chars=9).bounded().context_chars == 80
    assert for_target({"glossary_paths": {"en": "e.csv"}, "glossary_path": "r.csv", "target_lang": "ru"}, "en")["glossary_path"] == "e.csv"


def test_paths_and_logger(tmp_path):
    from textmill.plans.stages import Paths

    paths = Paths({"root": str(tmp_path), "tmp_dir": "work"}, "abc")
    assert paths.made() == str(tmp_path / "work" / "abc") and (tmp_path / "work" / "abc").is_dir()
    assert paths.of("a.json") == {"a.json": str(tmp_path / "work" / "abc" / "a.json")}
    for _ in range(2):
        log = paths.logger("textmill-test")
    log.debug("one line")
    assert (tmp_path / "log" / "textmill.log").read_text().count("one line") == 1


def test_guarded_files(tmp_path):
    import pytest

    from textmill.plans.stages import guarded

    source, target = tmp_path / "a", tmp_path / "b"
    source.write_text("x")
    copy = lambda s, t: open(t, "w").write(open(s).read())
    with pytest.raises(ValueError, match="itself"):
        guarded(str(source), str(source), copy, lambda s, t: None)
    with pytest.raises(ValueError, match="bad"):
        guarded(str(source), str(target), copy, lambda s, t: "bad")
    with pytest.raises(ValueError, match="nothing"):
        guarded(str(source), str(target), lambda s, t: None, lambda s, t: None)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a"]
    assert guarded(str(source), str(target), copy, lambda s, t: None) == str(target) and target.read_text() == "x"
    with pytest.raises(FileExistsError):
        guarded(str(source), str(target), copy, lambda s, t: None)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_configuration(tmp_path):
    import json

    import pytest

    from textmill import config

    (tmp_path / "c.json").write_text(json.dumps({"glossary_paths": {"en": "g"}}))
    got = config.load("c.json", "EN", str(tmp_path))
    assert (got["target_lang"], got["glossary_path"], got["root"], got["source_lang"]) == ("en", "g", str(tmp_path), "zh")
    assert config.for_target({"target_lang": "RU", "glossary_paths": "x"}, None)["target_lang"] == "ru"
    (tmp_path / "d.yaml").write_text("a: [")
    with pytest.raises(Exception):  # noqa: B017  which one depends on the reader
        config.load(str(tmp_path / "d.yaml"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from textmill.scratch import CLEANUP, stash

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, set_ = shuffled(), spark.conf.get(CLEANUP)
    rows = stash(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "rows")
    until = time.time() + 20  # they are deleted in the background
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and rows.count() == 10
    assert spark.conf.get(CLEANUP) == set_
