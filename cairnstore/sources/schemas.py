"""Fixed schemas of the store's relations; nothing is ever inferred."""

from __future__ import annotations

CHUNK_REF = "struct<id:string,plaintext_hash:string,len:bigint,clen:bigint,vol:string,seg:string>"
MANIFEST = f"struct<name:string,size:bigint,avg_chunk_size:bigint,file_hash:string,chunks:array<{CHUNK_REF}>>"
SEAL = "struct<vol:string,seg:string,bytes:bigint>"

FILES = "name string, content binary"
SEGMENT = "chunk_id string, plaintext_hash string, len bigint, clen bigint, ciphertext binary"
RECORD = (
    "version bigint, ts bigint, kind string, "
    f"put array<{MANIFEST}>, remove array<string>, seals array<{SEAL}>, "
    f"retired array<string>, repoint array<{MANIFEST}>, token string"
)
NAMESPACE = f"name string, size bigint, avg_chunk_size bigint, file_hash string, chunks array<{CHUNK_REF}>"
SEG_INDEX = "vol string, seg string, bytes bigint"

#: A checkpoint every so many records.
CHECKPOINT_INTERVAL = 128
