"""Schemas of the engine's tables."""

from __future__ import annotations

QUALIFIERS = "array<struct<relation:string,object:string,object_type:string>>"
TRIPLET = f"subject string, subject_type string, relation string, object string, object_type string, qualifiers {QUALIFIERS}"
VOCAB_ITEM = "kind string, item_id string, canonical_label string, count_per_normalized long, surface_forms array<string>, surface_form_counts map<string,long>"
SURFACE_TO_ID = "kind string, surface string, item_id string"
EDGE = "child string, parent string"
CONSTRAINT = "relation_id string, domain string, range string, support long, total long, pca_confidence double, strength string"
GOLD = "id string, sent string, triples array<struct<sub:string,rel:string,obj:string>>"
ESSAY = "id long, topic string, content string"
QUERY = "id long, topic string, queries array<string>"
QA = "id string, question string, answer string, answer_aliases array<string>"
EMBEDDING = "text string, vec array<float>"
