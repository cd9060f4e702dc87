"""A second source corpus: every ``part`` row is one file that exercises one group of rules.

The template is ``p_partkey % len(FORMS)``; ``%%`` in it stands for the part key, ``##`` for its
block of 200 keys, so files of one block and brand share an endpoint with many callers and
backends. The answer follows from the part keys alone (``plans/oracle_forms.py``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deadwire.sources.derived import BUCKET, dealt, read_table

#: (language, text): request models; Flask reads; Java; Go net/http; gin; Express; client classes
FORMS: tuple[tuple[str, str], ...] = (
    ("py", """from pydantic import BaseModel

class In%%(BaseModel):
    alpha%%: str
    beta%%: int

class Out%%(BaseModel):
    gamma%%: str

@app.post('/forms/x%%/a')
def make(data: In%%):
    return {"delta%%": 1}

def helper():
    return {"unseen%%": 1}

@app.post('/forms/x%%/b')
def take(item: Out%%):
    return {"eps%%": item.gamma%%}
"""),
    ("py", """from flask import request

@app.route('/forms/shared/s##')
def save():
    one = request.json.get('alpha%%')
    two = request.json['beta%%']
    body = request.json
    three = body.get('gamma%%')
    four = body['delta%%']
    five = request.form.get('eps%%')
    six = request.args.get('zeta%%')
    return one
"""),
    ("java", """package forms;

public class View%% {
    private String alphaP%%;
    @JsonProperty("beta_%%")
    private String betaP%%;

    public Map<String, Object> extra() {
        m.put("gamma%%", 1);
        return Map.of("omega%%", 1, "eps%%", 2);
    }
}

class Bound%% {
    private String zetaP%%;
}

class Api%% {
    @PutMapping("/forms/x%%/d")
    void put(@RequestBody Bound%% in) {
        save(in);
    }
    @PatchMapping("/forms/x%%/e")
    void patch(@RequestBody Other%% req, @RequestParam("eta%%") String a, @RequestParam int theta%%) {
        use(req.iota%%, request.getParameter("kappa%%"));
    }
}
"""),
    ("go", """package forms

type In%% struct {
	Alpha string `json:"alpha%%"`
}

type Out%% struct {
	Beta string `json:"beta%%,omitempty"`
	Hidden string `json:"-"`
	Gamma%% string
}

func save(w http.ResponseWriter, r *http.Request) {
	in := In%%{}
	json.NewDecoder(r.Body).Decode(&in)
	a := r.URL.Query().Get("delta%%")
	b := r.FormValue("eps%%")
	json.NewEncoder(w).Encode(map[string]any{"zeta%%": a})
	json.NewEncoder(w).Encode(map[string]interface{}{
		"eta%%": b,
	})
}

func routes() {
	http.HandleFunc("/forms/x%%/f", save)
	mux.HandleFunc("/forms/x%%/g", save).Methods("PUT")
	mux.Handle("/forms/x%%/h", nil).Methods(http.MethodPatch)
}
"""),
    ("go", """package forms

type Req%% struct {
	Alpha int `json:"alpha%%"`
}

func bind(r *gin.Engine) {
	r.POST("/forms/x%%/i", func(c *gin.Context) {
		var req Req%%
		c.ShouldBindJSON(&req)
		b := c.PostForm("beta%%")
		d := c.Query("gamma%%")
		c.JSON(200, gin.H{"omega%%": b, "eps%%": d})
	})
}
"""),
    ("ts", """router.route('/forms/x%%/j')
  .get(list)
  .post((req, res) => {
    res.status(201).json({ alpha%%: 1, nested%%: { beta%%: 2 }, used##s: 1, spare##s: 2 });
  });
app.get('/forms/shared/s##', list);
"""),
    ("ts", """class Client {
  stat = (id) => this.doFetch<User>(`${this.getUserRoute(id)}/x%%`, {method: 'put'});
  async send() {
    const out = await axios.patch('/forms/x%%/k', { alpha%%: 1 });
    const text = JSON.stringify({ beta%%: 2, gamma%%: 3 });
    await fetch('/forms/shared/s##');
    return out.delta%% + out.used##s;
  }
}
"""),
)


def form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, lang, content): one per part."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    part = dealt(part, part.count(), "p_partkey", "p_brand")
    form = F.pmod("p_partkey", F.lit(len(FORMS))).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in FORMS)), form + 1)
    key, block = F.col("p_partkey").cast("string"), F.expr(f"string(p_partkey div {BUCKET})")
    return part.select(
        F.concat(F.lit("brand"), F.regexp_replace("p_brand", "[^0-9]", "")).alias("repo"),
        F.concat(F.lit("forms/t"), form.cast("string"), F.lit("/p"), key, F.lit("."), pick(0)).alias("path"),
        pick(0).alias("lang"),
        F.replace(F.replace(pick(1), F.lit("%%"), key), F.lit("##"), block).alias("content"))
