"""The registered queries of this subpackage."""

from __future__ import annotations

from tidewater.llm import chat, clusters, repair, similarity
from tidewater.llm.chat import op4_chat
from tidewater.llm.clusters import op13_clusters
from tidewater.llm.extraction import op12_extraction
from tidewater.llm.licenses import op5_licenses
from tidewater.llm.media import op7_media
from tidewater.llm.mixing import op6_mixing
from tidewater.llm.neighbours import op10_neighbours
from tidewater.llm.packing import op1_packing
from tidewater.llm.quality import op9_quality
from tidewater.llm.repair import op11_repair
from tidewater.llm.sharding import op2_sharding
from tidewater.llm.similarity import op8_jaccard
from tidewater.llm.urls import op3_urls

QUERIES = {"op1_packing": op1_packing, "op2_sharding": op2_sharding, "op3_urls": op3_urls, "op4_chat": op4_chat, "op5_licenses": op5_licenses, "op6_mixing": op6_mixing, "op7_media": op7_media, "op8_jaccard": op8_jaccard, "op9_quality": op9_quality, "op10_neighbours": op10_neighbours, "op11_repair": op11_repair, "op12_extraction": op12_extraction, "op13_clusters": op13_clusters}
#: Packing, placement, mixing, learning and search follow greedy, random or learned choices
#: that SQL cannot repeat; tests hold those against brute force.
ORACLE: dict[str, str] = {"op4_chat": chat.ORACLE, "op8_jaccard": similarity.ORACLE, "op11_repair": repair.ORACLE, "op13_clusters": clusters.ORACLE}
