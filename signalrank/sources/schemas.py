"""Schemas of landed payloads and of the records that parsers return."""

from __future__ import annotations

#: What every paper parser returns, as columns.
PAPER = "title string, authors array<string>, abstract string, doi string, url string, published_at string, paper_type string, jel_codes array<string>, keywords array<string>, source string, source_id string, source_url string"
PAPER_COLUMNS = [c.split(" ")[0] for c in PAPER.split(", ")]
POST_COLUMNS = ["source", "source_id", "author_handle", "content", "url", "doi", "engagement_score", "published_at"]

ATOM_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, "
    "link array<struct<_href:string,_rel:string,_type:string,_title:string>>, doi string, comment string, primary_category struct<_term:string>"
)
RSS_ITEM = "title string, link string, guid string, description string, pubDate string"
RDF_ITEM = "_about string, title string, link string, description string, creator array<string>, date string, subject string"
OPENALEX_WORK = (
    "id string, title string, display_name string, doi string, type string, publication_date string, abstract_inverted_index map<string,array<int>>, "
    "primary_location struct<landing_page_url:string,source:struct<display_name:string>>, "
    "authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string,country_code:string>>>>, "
    "concepts array<struct<display_name:string,level:int>>"
)
_PARTS = "struct<`date-parts`:array<array<int>>>"
CROSSREF_WORK = (
    "title array<string>, DOI string, URL string, abstract string, author array<struct<given:string,family:string>>, "
    f"`published-online` {_PARTS}, created {_PARTS}, issued {_PARTS}, `published-print` {_PARTS}"
)
WDS = "documents map<string,string>"
WDS_DOCUMENT = "id string, display_title string, docdt string, dois string, url string, repnb string, pdfurl string, guid string, docna map<string,struct<docna:string>>, authors map<string,struct<author:string>>, abstracts map<string,string>"
RECOMMENDATIONS = "recommendedPapers array<struct<paperId:string,url:string,title:string,abstract:string,year:int,externalIds:map<string,string>,authors:array<struct<authorId:string,name:string>>>>"
SEARCH_RESULT = "id string, url string, title string, author string, authors string, text string, summary string, description string, publishedDate string, published_date string, publishedAt string, date string, doi string"
GRANTS = "data struct<hitCount:int,oppHits:array<struct<id:string,number:string,title:string,agency:string,openDate:string,closeDate:string,oppStatus:string,cfdaList:array<string>>>>"
STATUS = "id string, url string, uri string, content string, created_at string, favourites_count long, reblogs_count long, account struct<acct:string>"
BSKY_POST = "uri string, indexedAt string, likeCount long, repostCount long, replyCount long, author struct<did:string,handle:string>, record struct<text:string,createdAt:string>"
FEEDBACK = "paper_id long, interesting boolean, at string"
