"""Spark schemas of the document relations, and the vocabulary of nodes."""

from __future__ import annotations

_ATTRS = "struct<id:string,classes:array<string>,pairs:array<struct<key:string,value:string>>>"
BLOCK = (
    f"struct<forest:int,node:int,parent:int,depth:int,subtree_len:int,tag:string,text:string,attrs:{_ATTRS},entity:int,level:int,kind:string,start:bigint,style:string,delimiter:string,format:string,"
    "alignments:array<string>,row_head_columns:int,head_rows:int,alignment:string,row_span:int,col_span:int,owner:string,name:string,version:int>"
)
INLINE = f"struct<forest:int,block:int,node:int,parent:int,depth:int,subtree_len:int,tag:string,text:string,attrs:{_ATTRS},entity:int,url:string,title:string,resource:int,kind:string,format:string,note:int,id:string,owner:string,name:string,version:int>"
REPORT = "struct<seq:int,code:string,severity:string,consequence:string,loss:string,directions:string,exit_class:string,count:bigint,contexts:array<string>>"
METADATA = "struct<ordinal:int,key:string,value_type:string,value:string>"
RESOURCE = "struct<idx:int,source:string,mime:string,kind:string,content:binary,digest:string,pixel_width:int,pixel_height:int,alt:string>"
FACET = "struct<entity:int,kind:string,ordinal:int,fields:string>"
PLUGIN = "struct<id:string,version:int,data:string>"
PARSED = f"status string, format string, blocks array<{BLOCK}>, inlines array<{INLINE}>, metadata array<{METADATA}>, resources array<{RESOURCE}>, facets array<{FACET}>, plugins array<{PLUGIN}>, reports array<{REPORT}>"

BLOCK_TAGS = ["plain", "paragraph", "line_block", "heading", "code_block", "raw_block", "quote", "list", "definition_list", "thematic_break", "table", "figure", "container", "extension"]
#: Structural tags and the parents they may stand under.
STRUCTURE = {
    "line": ["line_block"], "list_item": ["list"], "definition_entry": ["definition_list"], "definition_term": ["definition_entry"], "definition_body": ["definition_entry"], "caption": ["table", "figure"],
    "table_head": ["table"], "table_body": ["table"], "table_foot": ["table"], "table_row": ["table_head", "table_body", "table_foot"], "table_cell": ["table_row"],
}
INLINE_TAGS = ["text", "space", "soft_break", "hard_break", "emphasis", "underline", "strong", "strikethrough", "superscript", "subscript", "small_caps", "quote", "code", "math", "raw", "link", "image", "note", "span", "citation", "extension"]
#: Parent -> what it may contain: blocks (any of BLOCK_TAGS), inlines, none, or the structural tags named.
CONTENT = {
    "plain": "inlines", "paragraph": "inlines", "heading": "inlines", "line": "inlines", "definition_term": "inlines", "code_block": "none", "raw_block": "none", "thematic_break": "none",
    "quote": "blocks", "container": "blocks", "extension": "blocks", "figure": "blocks", "list_item": "blocks", "definition_body": "blocks", "table_cell": "blocks", "caption": "blocks",
    "line_block": "line", "list": "list_item", "definition_list": "definition_entry", "definition_entry": "definition_term,definition_body", "table": "caption,table_head,table_body,table_foot",
    "table_head": "table_row", "table_body": "table_row", "table_foot": "table_row", "table_row": "table_cell",
}
