"""Small frames of a cycle, shared by tests."""

ITEM = '<item><title>%s</title><link>http://l/%s</link><description>%s</description></item>'


def frames(spark, words):
    body = "<rss><channel>" + "".join(ITEM % (w.title(), w, f"{w} says something else {w} every {i} time") for i, w in enumerate(words)) + "</channel></rss>"
    sources = spark.createDataFrame([(1, "s", "rss", True, "http://f", None)],
                                    "id long, name string, source_type string, active boolean, url string, x_handle string")
    landing = spark.createDataFrame([(1, "rss", 0, 200, body)], "source_id long, source_type string, mirror_rank int, status int, body string")
    news = spark.createDataFrame([], "id long, source_id long, title string, content string, url string, published_at string, "
                                     "fetched_at timestamp, summary_tr string, is_column boolean")
    sent = spark.createDataFrame([], "news_id long, sent_to_chat_id string, message_id long")
    chats = spark.createDataFrame([("a",), ("b",)], "chat_id string")
    return sources, landing, news, sent, chats
