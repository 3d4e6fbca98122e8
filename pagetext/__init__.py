"""pagetext: Spark jobs for recovering and translating text from page scans at corpus scale."""
