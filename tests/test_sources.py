from conftest import rows

from spanloom.sources import plans as L
from spanloom.sources import cues as Q
from spanloom.sources import docs as D

SRT = "1\n00:00:01,500 --> 00:00:02,250\n[ANN] hello\nthere\n\nnot a cue\n\n3\n00:00:02.500 --> 00:00:04.000\nplain\n\n4\nbad stamp\ntext\n"


def test_cue_modes(spark, tmp_path):
    (tmp_path / "film.srt").write_text(SRT)
    got = rows(Q.read_cues(spark, str(tmp_path)), "timeline_id", "index", "start_sec", "end_sec", "text")
    assert got == [("film", 1, 1.5, 2.25, "hello there"), ("film", 3, 2.5, 4.0, "plain")]
    blocks = rows(Q.read_cues(spark, str(tmp_path), "blocks"), "index", "speaker", "text")
    assert blocks == [(1, "ANN", "hello\nthere"), (3, "UNKNOWN", "plain"), (4, "UNKNOWN", "text")]
    assert rows(Q.read_cues(spark, str(tmp_path), "merge_int"), "start_sec", "end_sec", "text") == [(1, 2, "[ANN] hello there"), (2, 4, "plain")]


def test_cues_packed(spark, tmp_path):
    said = [(1, 1, 1500, 2250, "ANN", "hello"), (1, 2, 2500, 4000, None, "plain\ntext"), (2, 1, 0, 900, None, ""), (None, 1, 0, 900, None, "no id")]
    said += [(k, 1, 1000, 2000, None, f"t{k}") for k in range(3, 203)]
    s = spark.createDataFrame(said, "timeline_id bigint, ord int, start_ms bigint, end_ms bigint, speaker string, text string")
    Q.write_cues(s, f"{tmp_path}/packed", packed=True)
    Q.write_cues(s.filter("timeline_id < 3"), f"{tmp_path}/plain")
    assert not list((tmp_path / "packed").glob("*/")) and len(list((tmp_path / "packed").glob("*.parquet"))) <= 8
    for mode in ("float", "blocks"):
        got = Q.read_cues(spark, f"{tmp_path}/packed", mode, packed=True)
        assert got.filter("timeline_id >= 3").count() == 200 and [r.text for r in got.filter("timeline_id is null").collect()] == ["no id"]
        cols = [c for c in got.columns if c not in ("timeline_id", "speaker")]
        assert rows(got.filter("timeline_id < 3"), *cols) == rows(Q.cue_rows(Q.read_texts(spark, f"{tmp_path}/plain/*"), mode), *cols)


def test_boundaries_and_cuts(spark, tmp_path):
    (tmp_path / "m.txt").write_text("0 43\n\n43 102\n7\n102 102\n")
    b = Q.read_boundaries(spark, str(tmp_path))
    assert rows(b, "timeline_id", "start_frame", "end_frame") == [("m", 0, 43), ("m", 43, 102), ("m", 102, 102)]
    assert rows(Q.cut_points(b, 2.0), "cut") == [(21.5,), (51.0,)]


def test_documents_and_malformed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.json").write_text('{"k": ')
    assert rows(D.read_json_docs(spark, str(tmp_path), "k int"), "doc_key", "k") == [("a", 1)]


def test_documents_packed(spark, tmp_path):
    docs = [("a", '{"k": 1}'), ("b", '{"k": '), ("c", '{\n"k":\n 2}\n'), ("d", None), ("e", ""), (None, '{"k": 3}'), ("f", "[1]"), ("a", '{"k": 1}')]
    Q.write_texts(spark.createDataFrame(docs, "doc_key string, body string"), str(tmp_path / "x"), key="doc_key")
    got = D.read_json_docs(spark, str(tmp_path / "x"), "k int", packed=True)
    assert got.columns == ["k", "doc_key"]
    assert sorted((r.k, r.doc_key) for r in got.collect() if r.doc_key) == [(1, "a"), (1, "a"), (2, "c")] and got.filter("doc_key is null").count() == 1


def test_caption_map_drops_registries(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"0_5": {"x": 1}, "subject_registry": {}, "character_registry": {}}')
    assert rows(D.read_caption_map(spark, str(tmp_path)), "timeline_id", "key", "value") == [("c", "0_5", '{"x":1}')]


def test_catalog_reads_listing_only(spark, tmp_path):
    d = tmp_path / "Film_Song" / "short"
    d.mkdir(parents=True)
    (d / "shot_point_1.json").write_text("not even json")
    (d / "other.json").write_text("{}")
    assert rows(D.artifact_catalog(spark, f"{tmp_path}/*/*/*.json"), "movie", "audio", "type") == [("Film", "Song", "short")]


PLANS = [
    (1, '{"overall_theme": "x", "video_structure": [{"content": "c", "audio_section": "Intro", "start_time": 0, "end_time": 22.6, "related_scenes": [5, 6], "shot_plan": {"shots": ['
        '{"id": 1, "time_duration": 7.3, "content": "a", "emotion": "e", "related_scene": 4}, {"id": 2, "time_duration": 2, "related_scene": [3, 9]}, {"id": 3, "related_scene": "none"}, {"id": 4}]}},'
        '{"emotion": "flat", "start_time": "00:30"}]}'),
    (2, '{"video_structure": []}'), (3, "not json"), (4, None), (5, '{"video_structure": [{"shot_plan": {"shots": []}}]}'),
]


def test_plans(spark):
    docs = spark.createDataFrame(PLANS, "timeline_id int, body string")
    slots = {r.shot_idx: r for r in L.plan_slots(docs).collect()}
    assert len(slots) == 4 and [slots[i].scenes for i in range(4)] == [[4], [3, 9], [], []]
    assert (slots[0].section_idx, slots[0].id, slots[0].time_duration, slots[0].audio_section, slots[2].time_duration) == (0, "1", 7.3, "Intro", None)
    got = sorted((r.timeline_id, r.section_idx, r.start_time, r.end_time, r.scenes) for r in L.plan_sections(docs).collect())
    assert got == [(1, 0, 0.0, 22.6, [5, 6]), (1, 1, 30.0, None, []), (5, 0, None, None, [])]


def test_selections_there_and_back(spark):
    body = ('[{"status": "success", "section_idx": 0, "shot_idx": 1, "target_duration": 3.0, "clips": [{"shot": 1, "start": "00:01:05.500", "end": "00:01:07.000", "duration": 1.5},'
            '{"shot": 2, "start": "00:02:00", "end": "00:02:01"}], "protagonist_detection": {"method": "vlm", "total_frames_analyzed": 2, "frame_detections": [{"frame_idx": 7, "time_sec": 65.5, "protagonist_detected": true,'
            '"bounding_box": {"x": 1, "y": 2, "width": 30, "height": 40}}, {"frame_idx": 3, "protagonist_detected": false}]}}, {"status": "failed"}]')
    docs = spark.createDataFrame([(1, body), (2, '{"status": "single"}'), (3, "["), (4, None), (5, "[]")], "timeline_id int, body string")
    assert rows(L.load_selections(docs), "timeline_id", "selection", "status") == [(1, 0, "success"), (1, 1, "failed"), (2, 0, "single")]
    assert rows(L.selection_clips(docs), "selection", "clip", "shot", "start", "end") == [(0, 0, 1, 65.5, 67.0), (0, 1, 2, 120.0, 121.0)]
    assert rows(L.selection_detections(docs), "frame_idx", "protagonist_detected") == [(3, False), (7, True)]
    again = L.selection_docs(L.load_selections(docs), L.selection_clips(docs), L.selection_detections(docs))
    assert rows(L.selection_clips(again), "timeline_id", "selection", "clip", "start", "end") == rows(L.selection_clips(docs), "timeline_id", "selection", "clip", "start", "end")
    r = {x.timeline_id: x for x in L.load_selections(again).filter("selection = 0").collect()}[1]
    assert (r.frames, r.frames_with_protagonist, r.ratio, r.status) == (2, 1, 0.5, "success")
