"""Schemas and value domains of the engine's tables."""

from __future__ import annotations

#: Entity types in their order, and the states of a commitment.
TYPES = ("person", "project", "commitment", "term")
STATUSES = ("open", "done", "cancelled", "unknown")
MEETING_STATUSES = ("new", "transcribing", "recording", "done", "error")

SEGMENT = "start double, end double, text string, speaker string"
SEGMENTS = "meeting_id string, seg_idx bigint, start_sec double, end_sec double, text string, speaker string, is_gap boolean, no_speech_prob double, avg_logprob double"
FACT = "struct<text:string,date:string,source:string>"
ENTITY = (
    f"id string, type string, name string, aliases array<string>, summary string, facts array<{FACT}>, sources array<string>, "
    "status string, owner string, due string, created string, updated string, ord bigint"
)
DOCS = "kind string, name string, meeting_id string, content string"
GLOSSARY = "section string, ord int, term string, wrong array<string>, note string"
CHUNKS = "recording_id string, idx int, offset double, duration double, gap boolean"
CHUNK_STREAM = "rec_id string, seq bigint, payload binary, ts timestamp"
LOCALE = "code string, path string, value string"

#: File name endings by what reads them, and how rich each text form is (0 the richest).
TIMED = (".srt", ".vtt", ".sbv", ".lrc", ".ass", ".ssa", ".json", ".csv", ".tsv")
DOCUMENTS = (".docx", ".odt", ".pdf", ".eml")
TEXT_RANK = {
    ".json": 0, ".srt": 1, ".vtt": 2, ".sbv": 3, ".ass": 3, ".ssa": 3, ".lrc": 4, ".tsv": 5, ".csv": 5, ".md": 6, ".markdown": 7,
    ".txt": 8, ".rtf": 9, ".html": 9, ".htm": 9, ".docx": 10, ".odt": 10, ".pdf": 11, ".eml": 12,
}
AUDIO = (".m4a", ".mp3", ".wav", ".mp4", ".aac", ".flac", ".ogg", ".opus", ".webm", ".mov", ".mkv", ".amr", ".wma", ".aiff")

#: Section headings by language (people, projects, commitments, terms; glossary parts; labels).
LOCALES = {
    "en": {
        "sections": {"people": "People", "projects": "Projects & clients", "commitments": "Commitments & decisions", "terms": "Terms & usage", "names": "Names", "glossary_terms": "Terms", "glossary_title": "Glossary", "misheard": "misheard", "longterm_title": "Long-term memory", "transcript": "Transcript"},
        "msg": {"participants": "Participants", "participants_empty": "(not recorded)", "date": "Date", "duration": "Duration", "source": "Source", "status": {"open": "open", "done": "done", "cancelled": "cancelled", "unknown": "unknown"}},
        "templates": {"minutes": "Minutes", "actions": "Actions", "mood": "Mood", "tension": "Tension", "bias": "Bias", "topics": "Topics", "client": "Client", "hiring": "Hiring", "followup": "Follow-up"},
    },
    "zh-CN": {
        "sections": {"people": "人物", "projects": "项目与客户", "commitments": "承诺与决定", "terms": "术语与说法", "names": "人名", "glossary_terms": "专有名词", "glossary_title": "词表", "misheard": "误写", "longterm_title": "长期记忆", "transcript": "转写"},
        "msg": {"participants": "参与人员", "participants_empty": "（未记录）", "date": "日期", "duration": "时长", "source": "来源", "status": {"open": "进行中", "done": "已完成", "cancelled": "已取消", "unknown": "未知"}},
        "templates": {"minutes": "纪要"},
    },
    "fr": {
        "sections": {"people": "Personnes", "projects": "Projets et clients", "commitments": "Engagements et décisions", "terms": "Termes et expressions", "names": "Noms", "glossary_terms": "Termes", "glossary_title": "Glossaire", "misheard": "erreurs", "longterm_title": "Mémoire à long terme", "transcript": "Transcription"},
        "msg": {"participants": "Participants", "participants_empty": "(non renseigné)", "date": "Date", "duration": "Durée", "source": "Source", "status": {"open": "en cours", "done": "réalisé", "cancelled": "annulé", "unknown": "inconnu"}},
        "templates": {"minutes": "Compte rendu"},
    },
}
#: Languages asked in turn when a text is missing.
FALLBACK = ("en", "zh-CN")
#: Report templates and insight modes with the share of the minutes' length each may take.
TEMPLATES = {"minutes": 1.0, "actions": 0.5, "mood": 0.6, "tension": 0.7, "bias": 0.6, "topics": 0.6, "client": 0.8, "hiring": 0.8, "followup": 0.7}
TRACK_MODES = ("track", "signals", "synthesis")
