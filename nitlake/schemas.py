"""Schemas of the tables that users meet."""

MANIFEST = (
    "hdr_shard string, hdr_key string, sdr_shard string, sdr_key string, video string, "
    "frame int, tmo string, crf int, split string, source_dataset string"
)
HEADER_FIELDS = (
    "format", "tone_chain_version", "hdr_encoding",
    "hdr_mastering_peak_nits", "sdr_encoding", "gamut_mapping",
)
HEADER = (
    "type string, format string, tone_chain_version string, hdr_encoding string, "
    "hdr_mastering_peak_nits double, sdr_encoding string, gamut_mapping string"
)
PREDICTIONS = (
    "id string, video string, video_id string, sequence_id string, content_id string, "
    "frame_index int, frame int, variant string, track string, tmo string, crf int, "
    "category string, prediction string, reference string"
)
LEGACY = "id string, source string, category string, hdr string, sdr_variants map<string,string>"

SHARD_KEYS = ("hdr_shard", "hdr_key", "sdr_shard", "sdr_key")

#: What every corpus written here says of itself; a corpus that says otherwise is not continued.
CONVENTIONS = {
    "format": "nitlake-shards",
    "tone_chain_version": "1",
    "hdr_encoding": "16-bit PQ codes, BT.2020 primaries",
    "sdr_encoding": "8-bit codes, BT.709 primaries, power 2.4 display",
    "gamut_mapping": "matrix, then clip",
}
