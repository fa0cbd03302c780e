"""Schemas of the stored tables, as DDL."""

TABLES = {
    "files": "file_id string, name string, version string, origin string, sender_email string, sender_name string, sha256 string, content binary",
    "messages": "process_id string, message_id string, subject string, from_name string, from_email string, recipients array<struct<name:string,email:string>>, sent_at timestamp, sent_raw string, body string, is_mdn boolean, has_attachment boolean, attachment_names array<string>, source_file string, ingest_seq bigint, type string, confidence int, summary string, classified_at timestamp",
    "attachments": "message_id string, pos int, name string, mime string, sha256 string, content binary",
    "items": "process_id string, file_id string, supplier string, seq bigint, item_no string, material_code string, description string, unit string, quantity double, unit_price double, total_price double, extraction_source string, location string, item_confidence string, extraction_version string",
    "documents": "file_id string, supplier string, structural_confidence int, route string, truncated boolean, tax_id string, phone string, error string, version string, extraction_version string, usage struct<prompt:bigint,completion:bigint,total:bigint,cost:double,estimated:boolean>",
    "cells": "file_id string, grid_id string, row int, col int, text string",
    "pages": "file_id string, page int, text string, from_ocr boolean",
    "master": "process_id string, item_no string, material_code string, description string, seq bigint",
    "corrections": "desc_a string, desc_b string, decision string, origin string, created_at timestamp",
    "map_rows": "process_id string, row_id string, key_kind string, row_seq bigint, item_no string, material_code string, description string, quantity double, unit string, is_master boolean",
    "price_cells": "process_id string, row_id string, supplier string, unit_price double, quantity double, unit string, confidence string, file_id string",
    "review": "process_id string, kind string, item_no string, new_desc string, matched_desc string, score double, seq bigint",
    "sources": "supplier string, file string, extraction_source string, location string, item_no string, description string",
    "processes": "process_id string, number string, title string, descr string, created_at timestamp",
    "suppliers": "email string, name string, tax_id string, phone string",
    "participations": "process_id string, email string, sent_quote boolean, declined boolean, read_ok boolean, asked boolean, requested_at timestamp, first_reply_at timestamp",
    "quote_links": "process_id string, file_id string, file_name string, sender_email string, created_at timestamp",
    "usage": "process_id string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cost double, runs bigint, updated_at timestamp",
    "verdicts": "pair_id bigint, same_item boolean, confidence double",
    "coverage": "process_id string, row_id string, item_no string, description string, n_quotes int, pct double",
}
