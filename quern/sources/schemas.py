"""Schemas of a question-and-answer dump."""

from __future__ import annotations

from pyspark.sql.types import StructType

_FIELDS = {
    "posts": "id int, posttypeid int, acceptedanswerid int, parentid int, creationdate timestamp, score int, viewcount int, body string, owneruserid int, ownerdisplayname string, lasteditoruserid int, lasteditordisplayname string, lasteditdate timestamp, lastactivitydate timestamp, title string, tags string, answercount int, commentcount int, favoritecount int, contentlicense string",
    "users": "id int, reputation int, creationdate timestamp, displayname string, lastaccessdate timestamp, aboutme string, views int, upvotes int, downvotes int",
    "comments": "id int, postid int, score int, text string, creationdate timestamp, userid int",
    "votes": "id int, postid int, votetypeid int, creationdate timestamp",
    "badges": "id int, userid int, name string, date timestamp, class int, tagbased boolean",
    "tags": "id int, tagname string, count int, excerptpostid int, wikipostid int",
    "postlinks": "id int, creationdate timestamp, postid int, relatedpostid int, linktypeid int",
    "posthistory": "id int, posthistorytypeid int, postid int, revisionguid string, creationdate timestamp, userid int, text string, contentlicense string",
}
TABLES = tuple(_FIELDS)


def schema(table: str) -> StructType:
    return StructType.fromDDL(_FIELDS[table])


#: Foreign keys as (table, column, parent).
REFERENCES = (
    ("posts", "owneruserid", "users"), ("posts", "lasteditoruserid", "users"), ("comments", "postid", "posts"), ("comments", "userid", "users"),
    ("votes", "postid", "posts"), ("badges", "userid", "users"), ("postlinks", "postid", "posts"), ("postlinks", "relatedpostid", "posts"), ("posthistory", "postid", "posts"),
)
