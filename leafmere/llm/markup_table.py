"""The labelled table that the markup trees are trained on, written for this purpose: short texts, block by block, so that
every block has real neighbours.

A line is a label, a bar and the block. The label is the block's kind, p(rose), h(eading), l(ist), c(ode), f(ormula),
t(able) or s(caffold, markup without text of its own), in capitals if the block holds markup source. A line without a bar
separates two texts.
"""

TABLE = r"""
h|Winter schedule overview
p|The committee met twice in spring and agreed that the old ledger would be kept until the audit ends.
p|Ask Q&A staff or the R&D desk about it, since AT&T has no part in this.
p|Tickets cost $5 before noon and $12 after, which is about 30% more than last year.
p|See issue #42 and page [7] for the details of the snake_case_name rule.
p|Files lie under C:\temp\new_notes\item or in ~/notes/today on the other machine.
p|Copy D:\begin\item_7 to D:\section\part before the disk is full.
p|When n < 40 and m > 7 the rate is 3^2 per day, and x<y or y>z holds.
p|I <3 this place, it is old -> new again, 5' 10'' tall and ~40 of them came.
p|Rename file_name_v2* and use {name}: {count} as the pattern of 2 * 3 * 4 boxes.
p|A Map<String, int> of sizes goes into a List<String> without a cast.
p|Please mark !important things, then run scan | sort | head once more.
p|Nobody said so - not then, not later - and the meeting went on as planned.
l|• Replace the filter in the cellar
l|• Ring the office before noon
t|station	value
t|harbour	412
h|Pending repairs
p|Nothing else was reported. The crew left at 17:30.
next
p|The loop below adds up the costs of all rows, and the second one stops early.
c|for (i = 0; i < n; i++) total += cost[i];
c|if (a < b && c > d) return snake_case_id;
c|let List<String> parts = split(path);
c|final x = rows.where((e) => e.size > 40).length;
c|print(open_count * 2 * 3);
c|assert n == 5, 'bad length';
c|while (left <= right) left += 1;
c|def area(w, h): return w * h
p|After that the result is written to the log and the program ends.
next
p|The circle of radius r is given by the first of these.
f|x^2 + y^2 = r^2
f|sum of w_i x_i
f|n / (k + rank)
f|a <= b
f|t1 - t0 > 60
f|sqrt(d) / 2
p|The others are limits on the time between two readings.
next
p|Call __init__ before the first use of the class, and never twice.
p|The module asks whether __name__ is the main one before it starts.
p|Both __enter__ and __exit__ have to be there for that to work.
p|A file called __main__ is run first when the folder itself is started.
next
p|The handler is looked up in the first column and called at once.
c|value = row[0](key) + 1
c|handlers[name](event);
c|table[i](x, y)
c|out = steps[k](out)
p|It gives back what the handler gives back, plus one for the header.
next
p|The greeting is put together from both names before it is shown.
c|let s = `a${b}`;
c|const name = `${first} ${last}`;
c|return `${path}/${file}`;
c|log(`done`);
p|Nothing is shown while either of the names is still unknown.
next
p|The vector is filled from the second file and sorted once.
c|std::vector<p> v;
c|std::map<a, b> m;
c|Box<i> box = new Box<>();
c|Set<a> seen;
c|auto it = std::list<s>();
p|Sorting twice would not change it, but it costs some time.
next
p|The counter is set up first, and then the rows are read one by one.
c|# set up the counter
c|count = 0
c|# read the rows
c|for row in rows: count += row.size
c|# one more for the header
c|count += 1
c|# then print it
c|print(count)
p|The last line shows how many there were.
next
c|import os
c|# where the notes are kept
c|root = os.environ["NOTES"]
c|# open the first of them
c|first = open(root + "/first.txt")
p|The regex \w{3} and \d{2} take three letters and two digits.
p|With \s{2} or \b{1} it also sees the gap between two of them.
p|Another one, \d{4}-\d{2}, finds the months of a year in the log.
next
p|Nobody had expected the thaw to come so early in the year.
p|- 5 degrees were measured at noon, and the ice on the pond held until the evening of that day.
p|The wind turned in the night and brought rain from the west.
p|- 12 was the lowest reading of the winter, taken by the keeper of the lighthouse on the cape.
p|The same had been seen ten years before, when the harbour froze.
next
p|The hall was booked for a hundred, and half of the seats stayed empty.
p|> 40 of them came by boat, and the rest walked along the shore with their lamps.
p|Nobody counted those who left before the speech was over.
p|> 3 was the answer that most of them gave when they were asked how often they come.
p|The count was given to the paper on the next morning.
next
p|- 5 degrees were measured at noon
next
p|It was cold in the hut.
p|- 8 was read at dawn
p|Then the sun came out.
p|- 2 was read at ten
next
p|> 40 of them came
next
p|The rest stayed away.
p|> 12 had left early
p|Nobody asked them why.
p|> 7 did not answer
p|Their names were kept.
next
L|- Sweep
L|- Dust
next
p|Most of it was ready by then, and what was missing could wait.
L|- Bread and salt for the new house
P|> and a bottle of wine from the cellar
p|They had carried everything up the stairs before it was noon.
next
P|The **loop** below adds up what is left and stops at the first gap.
C|    x = *a* + _b_;
C|    total = *sum* / __count__;
C|    run(*args, **kwargs) || [0](k);
C|	if (*p == _q_) return `p`;
C|    first = [a](b);
C|    n = [1](2);
C|    out = [c](m);
c|    rest = **first;
P|It runs for *every* row of the table.
next
p|It runs for each row of the table, and the last one is left out.
C|    z = [3](q);
C|    w = [4](z);
next
S|<ul>
L|    <li>Take the lamp</li>
L|    <li>Light <b>it</b> first</li>
S|</ul>
L|    - Mend the <em>old</em> net
P|    All of *this* was said by the keeper to those who came.
next
H|# seeds
p|They are kept dry over the winter and sown after the last frost.
H|# tools and ropes
p|Hang them behind the door, and put the ladder back where it was.
H|# about the old well
p|It was dug by hand.
next
H|# Cellar inventory
P|The **north** gate stays closed while the paving is replaced next week.
H|## Garden plan
L|- Water the plants
L|- Close the gate
L|- Mend the fence
H|### Open questions
P|We saw *three* of them and wrote the numbers down in the yellow notebook.
P|Set `verbose` to see what the program does while it reads the archive.
P|The ~~first~~ second proposal was accepted without any further discussion.
P|More is said in [the guide](./guide.md) about the handling of old paper.
P|The picture ![map](img/map.png) shows the valley as it was in those days.
P|This was doubted[^1] by those who had never been to the island itself.
S|[3]: ./guide.md "the guide"
next
H|# Tools
p|They hang on the wall behind the door, the saw above the plane.
H|# Seeds
p|Dry ones are kept in jars, and the rest is sown before the end of May.
H|## About the well
p|It was dug by hand and holds water in every month of the year.
next
h|Notes of the week
P|> he said that the road was closed and would stay so until the thaw
p|That was on the first day, and no one has been there since.
P|> the bridge is gone as well
p|It was the last one to cross the river above the mill.
next
p|What is left to do before the guests arrive is short.
L|- Sweep the yard
L|- Carry in the wood
L|- Light the stove
p|The rest can wait until the morning after.
L|* Wash the cups
L|* Lay the table
L|** Fold the napkins
next
p|Bring the following with you when you come on Monday.
L|- 2 lamps
L|- 4 ropes
L|- 1 map of the valley
L|- [ ] Call the plumber
L|- [x] Pay the bill
p|Everything else is there already.
next
l|1. Open the valve
l|1. Wait for the signal
l|1. Close it again
p|It should not drip afterwards.
l|1. Open the window
l|2. Let the smoke out
l|3. Close it again
next
h|Timetable
S|================
p|The boat leaves at dawn and comes back when the tide allows it.
h|Prices
S|----------
p|Children pay half, and dogs pay nothing at all.
S|---
p|All of it may change without notice.
S|___
next
p|The function reads one line and splits it at every blank.
S|```dart
c|var seen = Map<String, int>();
c|if (a < b && c > d) return snake_case_id;
S|```
p|Another one joins the parts again.
S|~~~
c|return parts.join(' ');
S|~~~
next
T|| station | 42 |
S||---|--:|
T|| harbour | 7 |
T|| river | 12 |
p|The readings were taken at noon by the keeper of each station.
next
P|Use __two words__ in bold where the sign is to be read aloud.
P|The __last call__ for the ferry is given ten minutes before it leaves.
P|A ***very old*** map hangs in the hall, and a _small one_ beside it.
next
S|<!DOCTYPE html>
S|<html><head>
S|</head><body>
H|<h1 class="t">Timetable</h1>
P|<p>The boat leaves at dawn and comes back when the tide allows it.</p>
H|<h2>Opening hours</h2>
P|<div class="body">No one had opened the door since the storm of last autumn.</div>
H|<H3>Prices</H3>
S|<ul>
L|<li>Bring a lamp</li>
L|<LI>Bring a rope</LI>
S|</ul>
T|<table><tr><td>river</td><td>7</td></tr></table>
P|<td>harbour
S|<hr />
C|<pre><code>var seen = Map&lt;String, int&gt;();
C|if (a &lt; b &amp;&amp; c &gt; d) return snake_case_id;</code></pre>
F|<p><i>n / (k + rank)</i></p>
S|<!-- made by hand -->
S|</body></html>
next
P|They walked along the <em>old</em> wall and rested in its shade until noon.
P|A cup of tea &amp; a slice of bread is all that anyone needs on such a day.
P|The harbour&nbsp;master wrote a letter to the town and waited for an answer.
P|It is the captain&#8217;s duty to count them before the ship leaves port.
P|The line breaks here<br/>and goes on as if nothing had happened at all.
P|Each member <!-- check --> may borrow two books for the length of a month.
P|The door<b>bell</b> was heard by everyone in the house, and nobody went.
P|He left the<i> key</i> under the stone, where she had told him to.
P|It ended with the harvest of that year.</p>
P|<a href="one.html">Home</a> <a href="two.html">Maps</a> <a href="three.html">Letters</a>
next
H|== Early history ==
P|The '''great''' fire destroyed the mill and the houses on the left bank.
P|It was ''never'' repaired, although the money had been put aside for it.
P|The [[river]] floods the meadows of the [[Lower valley|valley]] each spring.
H|=== Later years ===
P|The tower{{note|old}} was used as a store for grain after the war.
P|The bridge<ref name="a">memo 4</ref> was built in stone by the monks.
S|{| class="wikitable"
S||-
T|| harbour || 42
S||}
S|<syntaxhighlight lang="dart">
c|var n = rows.length;
S|</syntaxhighlight>
F|<math>\sqrt{d} / 2</math>
P|See [https://example.org/a the first list] for all of them.
next
S|\documentclass{article}
S|\begin{document}
H|\section{Materials and methods}
P|As shown by \cite{miller07} the effect vanishes once \emph{all} samples are dry.
P|The results in \ref{sec:results} agree\footnote{Within error.} with the model.
P|Let $x_i^2$ be the weight and \(n + 1\) the number of samples in the set.
P|The term {\it archive} is used here for any collection of dated papers.
H|\subsection*{Limits}
S|\begin{itemize}
L|\item Weigh the sample twice
S|\end{itemize}
F|$$x^2 + y^2 = r^2$$
F|$$\frac{n}{k + rank}$$
F|\[ a + b = c \]
F|$\sum_i w_i x_i$
S|\begin{tabular}{lr}
T|station & 42 \\
T|harbour & 7 \\
S|\end{tabular}
P|It was seen by~all of them, as ``they'' said in \cite{lee99}.
S|\end{document}
next
p|The last ferry had gone, and so they slept in the waiting room until six.
p|She wrote a~b where a blank should have stood, and nobody saw it.
p|They called it ``the hole'' in those days, for want of a better word.
t|name & place, both on one line \\
h|Closing remarks
p|All of it is stored by the hash of its content, so two records can share one copy.
p|A ratio of 3:2 is fine, but 5*4 and 2**8 need no sign at all.
"""

KIND_LETTERS = {"p": "prose", "h": "heading", "l": "list", "c": "code", "f": "formula", "t": "table", "s": "scaffold"}


def texts() -> list[list[tuple[str, bool, str]]]:
    """(kind, holds markup source, block) of the blocks of each text."""
    out: list[list[tuple[str, bool, str]]] = [[]]
    for line in TABLE.strip("\n").split("\n"):
        label, bar, block = line.partition("|")
        if bar:
            out[-1].append((KIND_LETTERS[label.lower()], label.isupper(), block))
        else:
            out.append([])
    return out
