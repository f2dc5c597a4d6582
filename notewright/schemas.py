"""Explicit schemas of the tables the operators take and give; every table leads with song_id and an explicit order column."""

from __future__ import annotations

TOKENS = "song_id string, seq int, word string, start double, end double, confidence double, is_hyphen boolean, is_word_end boolean"
SILENCES = "song_id string, sil_idx int, start double, end double"
NOTES = "song_id string, seq int, note string, start double, end double, word string"
FRAMES = "song_id string, frame_idx int, t double, freq double, conf double"
NOTE_LINES = "song_id string, line_no int, note_type string, start_beat double, duration double, pitch int, word string, start_time double, end_time double"
HEADERS = ("version artist title year genre mp3 audio video video_url video_gap gap bpm language cover cover_url background vocals instrumental tags creator comment").split()
SONG_HEADERS = "song_id string, " + ", ".join(f"{h} string" for h in HEADERS)
ASR_RESULT = "segments array<struct<words:array<struct<word:string,start:double,end:double,score:double>>>>, language string"
